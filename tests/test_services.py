import json

import pytest
from pyspark.sql import functions as F

from claimloom.functions import redaction
from claimloom.operators import contract, detectors, ranking, records, store
from claimloom.session import written


def test_gates_come_in_order(spark):
    p = {"min_characters": 5, "max_characters": 8, "languages": ["en-GB"]}
    rows = [("abc", "en"), ("abcdef  ", "EN-us"), ("abcdefghij", "en"), ("abcdef", "de"), ("abcdef", None), (None, "en")]
    df = spark.createDataFrame(rows, "t string, l string")
    got = [r[0] for r in df.select(detectors.gate_text(F.col("t"), F.col("l"), p)).collect()]
    assert got == ["TEXT_TOO_SHORT", None, "TEXT_TOO_LONG", "LANGUAGE_NOT_SUPPORTED", "LANGUAGE_NOT_SUPPORTED", "TEXT_TOO_SHORT"]
    assert {r[0] for r in df.select(detectors.gate_text(F.col("t"), F.col("l"), p, configured=False)).collect()} == {"PROVIDER_UNCONFIGURED"}
    images = spark.createDataFrame([(10, 99, 5), (99, 99, 500), (99, 99, 5), (None, 99, 5)], "w int, h int, n int")
    gate = lambda **k: [r[0] for r in images.select(detectors.gate_image(F.col("w"), F.col("h"), F.col("n"), {"min_pixels": 64, "max_bytes": 100, **k})).collect()]
    assert gate() == ["IMAGE_TOO_SMALL", "IMAGE_TOO_LARGE", None, "IMAGE_TOO_SMALL"]
    assert gate(upload_style="url_reference")[2] == "UPLOAD_STYLE_UNSUPPORTED"


def test_registry_never_falls_back():
    whole = {"modality": "text", "endpoint": "https://x.test", "score_path": "s", "scale": {"min": 0, "max": 1, "higher_means_ai": True}, "required_config": ["key"]}
    status = lambda name, mode="live", keys=None: detectors.registered("text", name, mode, {"text:x": whole, "text:bad": whole | {"scale": {"min": 0}}}, keys or {})["status"]
    assert [status("none"), status(None), status("fixture"), status("fixture", "demo"), status("other"), status("bad"), status("x"), status(" X ", keys={"key": "k"})] == ["disabled", "disabled", "unconfigured", "ok", "unconfigured", "unconfigured", "unconfigured", "ok"]
    with pytest.raises(ValueError, match="scale.max"):
        detectors.parse_profile("bad", whole | {"scale": {"min": 0, "higher_means_ai": True}})


def test_signals_have_their_target_and_scale(spark):
    rows = [("ok", 0.2, None, "h", "claim_text"), ("ok", 0.2, "a", None, "image"), ("ok", 0.2, "a", "h", "image"), ("unsupported", 0.9, None, "h", "ocr_text"), ("ok", 3.0, None, "h", "claim_text"), ("ok", 0.2, None, "h", "other")]
    df = spark.createDataFrame(rows, "status string, raw_score double, asset string, sha string, kind string").withColumn("error_code", F.lit(None).cast("string"))
    made = lambda scale: [r[0] for r in detectors.build_signals(df, F.lit("0" * 32), F.lit(7), "p", F.col("kind"), F.col("asset"), F.col("sha"), scale, ["x", "y", "x"], "v").select("signal").collect()]
    down = made((0.0, 1.0, False))
    assert [s and (s.ai_generated_score, s.assessment) for s in down] == [(0.8, "likely_ai_generated"), (0.8, "likely_ai_generated"), None, (None, "not_assessed"), (None, "uncertain"), None]
    assert down[0].signal_id == f"fs_{'0' * 32}_000007" and down[0].limitations[:2] == ["x", "y"] and len(down[0].limitations) == 3 and down[1].modality == "image"
    unknown = made(None)
    assert unknown[0].ai_generated_score is None and unknown[0].assessment == "uncertain" and unknown[0].raw_scale is None and len(unknown[0].limitations) == 3


def test_branch_that_fails_is_alone(spark):
    def boom():
        return spark.range(3).select(F.raise_error(F.lit("boom")).cast("string").alias("x"))

    signals, warnings = detectors.isolated(spark, "forensics.text", boom, written)
    assert signals is None and [(r.code, r.component) for r in warnings.collect()] == [("TEXT_DETECTOR_FAILED", "forensics.text")]
    signals, warnings = detectors.isolated(spark, "forensics.image", lambda: spark.range(2), written)
    assert signals.count() == 2 and warnings.count() == 0


def test_paths_count_from_the_end(spark):
    df = spark.createDataFrame([('{"a": [1, 2], "b": {"0": {"c": "x"}}}',), ('{"a": []}',), ("nope",), (None,)], "j string")
    at = lambda path: [tuple(r) for r in df.select(*detectors.response_score(F.col("j"), path)).collect()]
    assert at("a.-1")[:3] == [(2.0, None), (None, "SCORE_MISSING"), (None, "RESPONSE_MALFORMED")]
    assert at("a.0")[0] == (1.0, None) and at("a.2")[0] == (None, "SCORE_MISSING") and at("a.-3")[0] == (None, "SCORE_MISSING")
    assert at("b.0.c")[0] == (None, "SCORE_NOT_A_NUMBER")


def test_secrets_go(spark):
    body = json.dumps({"user": {"Password": "p", "list": [{"token": 1, "x": 2}]}})
    df = spark.createDataFrame([(body, {"COOKIE": "c", "a": "b"}), (None, None), ("{", {})], "j string, h map<string,string>")
    rows = df.select(redaction.redact_json(F.col("j")), redaction.redact_headers(F.col("h"))).collect()
    assert json.loads(rows[0][0]) == {"user": {"Password": "<redacted>", "list": [{"token": "<redacted>", "x": 2}]}} and rows[0][1] == {"COOKIE": "<redacted>", "a": "b"}
    assert rows[1][0] is None and rows[2][0] == "<redacted>"


def test_jobs(spark):
    log = spark.createDataFrame([(1, "queued", 1), (1, "running", 2), (1, "succeeded", 3), (1, "running", 4), (2, "running", 1), (3, "queued", 1), *[(3, s, 2 + i) for i, s in enumerate(["running", "queued"] * 3 + ["running"])]], "job long, status string, at long")
    assert sorted((r.job, r.at) for r in store.wrong_steps(log, "job", "status", "at", "at").collect()) == [(1, 4), (2, 1), (3, 8)]
    needed, off = spark.createDataFrame([(True,), (True,)], "ok boolean"), spark.createDataFrame([("x", "disabled")], "c string, status string")
    say = lambda n, o: tuple(store.readiness(n, o).first())
    assert say(needed, off) == ("degraded", 200) and say(needed, off.limit(0)) == ("ready", 200) and say(needed.limit(0), off) == ("not_ready", 503)
    runs = spark.createDataFrame([("r", '{"evidence_list": [{}, {}], "forensic_signals": []}'), ("s", None)], "r string, j string")
    assert [(x.evidence_count, x.signal_count) for x in store.with_counts(runs, "j").orderBy("r").collect()] == [(2, 0), (0, 0)]
    v = spark.createDataFrame([("a", "C", f"p{i:02d}") for i in range(30)] + [("b", "C", "p")], "row string, code string, path string")
    got = {r.row: r for r in store.capped_details(v, "row").collect()}
    assert (got["a"].violation_count, got["a"].truncated, len(got["a"].violations)) == (30, True, 25) and not got["b"].truncated


def test_idempotency_of_null_keys(spark):
    df = spark.createDataFrame([(1, None, "h", 1), (2, None, "h", 2), (3, "k", "x", 1), (4, "k", "y", 2)], "id long, k string, h string, at long")
    assert {r.id: (r.first_id, r.replay) for r in store.idempotent(df, ["k"], "h", "at", "id").collect()} == {1: (1, "new"), 2: (1, "same"), 3: (3, "new"), 4: (3, "conflict")}


def test_cycles_name_their_members_only():
    atoms = [{"atom_id": a, "depends_on": n} for a, n in (("a000001", ["a000001"]), ("a000002", ["a000001"]), ("a000003", ["a000004"]), ("a000004", ["a000003"]), ("a000005", ["a000003"]))]
    say = contract.Report()
    contract._dependencies(atoms, "$", say)
    assert [m for _, _, m in say.found] == ["a000001 needs itself", "among a000001, a000003, a000004"]


def test_records_of_runs(spark):
    from datetime import datetime as dt

    t = dt(2026, 1, 1)
    runs = spark.createDataFrame([("r1", "c1", 1, "demo", "completed", None, t), ("r2", "c1", 2, "live", "completed", t, t), ("r3", "c2", 1, "live", None, None, t)], "run_id string, case_id string, claim_revision int, mode string, status string, as_of timestamp, created_at timestamp")
    items = spark.createDataFrame([("r1", f"k{i}", [0.5, None, float("nan"), 7.0][i % 4], 0.5, 0.01, t) for i in range(23)] + [("r1", "k0", 0.9, 0.5, 0.01, dt(2026, 1, 2))], "run_id string, key string, relevance_score double, credibility double, fusion_score double, ranked_at timestamp")
    found = spark.createDataFrame([("r1", "k0", " ", " ", "", "P", "not a tag!", "2025-01-01", "p", "news", "Full", "m", t)], "run_id string, key string, title string, text string, url string, publisher string, language string, published_at string, provider string, kind string, content_status string, discovery_method string, retrieved_at timestamp")
    groups = spark.createDataFrame([("k0", "dc_1", None)], "key string, duplicate_cluster_id string, independence_group_id string")
    made = records.bundles(runs, records.roll_up(runs, records.evidence(items, found, groups, runs)), "case_id")
    assert contract.validate(made, "run_id", "bundle").count() == 0
    got = {r.run_id: json.loads(r.bundle)["retrieval"] for r in made.collect()}
    assert [len(got[r]["evidence_list"]) for r in ("r1", "r2", "r3")] == [20, 0, 0]
    assert [len(got[r]["run"]["warnings"]) for r in ("r1", "r2", "r3")] == [0, 1, 0] and got["r3"]["run"]["status"] == "partial"
    raw = records.bundles(runs, records.roll_up(runs, records.evidence(items, found, groups, runs, raw=True)), "case_id")
    assert {r.code for r in contract.validate(raw, "run_id", "bundle").collect()} >= {"ENUM_INVALID", "SCORE_OUT_OF_RANGE"}


def test_budget_makes_runs_partial(spark):
    log = spark.createDataFrame([("a", 1, 30.0), ("a", 2, 20.0), ("a", 3, 1.0), ("b", 1, 99.0), ("c", 1, None), ("c", 2, 1.0)], "run string, step int, s double")
    got = {(r.run, r.step): (r.executed, r.run_status) for r in records.within_budget(log, "run", ["step"], "s").collect()}
    assert got == {("a", 1): (True, "partial"), ("a", 2): (True, "partial"), ("a", 3): (False, "partial"), ("b", 1): (True, "completed"), ("c", 1): (True, "completed"), ("c", 2): (True, "completed")}


def test_neighbours_in_blocks_are_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=4).round(2).tolist()) for i in range(60)] + [(60, [0.0] * 4), (61, None), (62, [1.0, 0.0, 0.0, 0.0]), (63, [2.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    ask = df.where("id % 9 = 0 or id >= 60")
    one, many = ([tuple(x) for x in ranking.dense_neighbours(df, ask, "id", "v", 3, block).orderBy("query", "rank").collect()] for block in (20_000, 3))
    assert one == many
    at = dict(x for x in rows if x[1] is not None)
    cos = lambda a, b: round(float(np.dot(a, b) / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-300)), 6)
    for q in {x[0] for x in one}:
        best = sorted((-cos(np.float32(at[q]).astype(float), np.float32(v).astype(float)), i) for i, v in at.items() if i != q)[:3]
        assert [(x[1]) for x in one if x[0] == q] == [i for _, i in best] and len([x for x in one if x[0] == q]) == 3
