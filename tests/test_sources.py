import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from claimloom.operators import detectors
from claimloom.session import dropped, written
from claimloom.sources import corpus, media
from claimloom.streaming import jobs


def test_jsonl(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id":"1","text":"a","kind":"news"}\n\n{"id":"2"\n{"id":"3","text":null,"extra":1}\n{"id":"4","id":"5"}\n  \n{"id":NaN}\n', encoding="utf-8")
    good, bad = corpus.read_jsonl(spark, str(tmp_path / "c.jsonl"))
    assert sorted(r.id for r in good.collect()) == ["1", "3"] and good.columns == corpus.FIELDS
    assert bad.count() == 3
    assert corpus.capability(good).first().asDict() == {"provider": "local_corpus", "capability": "local_corpus_search", "status": "ok", "message": "2 documents"}
    assert corpus.capability(good.limit(0)).first().status == "unconfigured"


def test_failing_provider_is_left_out(spark):
    good = lambda: spark.createDataFrame([(1,)], "doc int")
    broken = lambda: good().select(F.raise_error(F.lit("down")).cast("int").alias("doc"))
    hits, status = corpus.gather(spark, {"a": good, "b": broken}, written)
    assert hits.count() == 1 and {r.provider: r.status for r in status.collect()} == {"a": "ok", "b": "failed"}
    assert max(len(r.message) for r in status.collect()) <= 500
    dropped(hits)


def test_profiles_and_sink(spark, tmp_path):
    (tmp_path / "p.toml").write_text('[[detectors]]\nmodality = "text"\nname = "x"\nmin = 0\n')
    assert list(corpus.load_profiles(tmp_path / "p.toml")) == ["text:x"]
    (tmp_path / "p.toml").write_text("not toml [")
    assert corpus.load_profiles(tmp_path / "p.toml") == corpus.load_profiles(tmp_path / "none.toml") == {}
    df = spark.createDataFrame([(1,)], "i int").select(F.struct(F.lit("é😀").alias("t")).alias("bundle"))
    corpus.write_bundles(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"t":"é😀"}'


def png(w, h):
    body = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + body + struct.pack(">I", zlib.crc32(b"IHDR" + body))


def jpeg(w, h, orientation=None):
    exif = b""
    if orientation:
        t = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHIHH", 0x0112, 3, 1, orientation, 0)
        exif = b"\xff\xe1" + struct.pack(">H", len(t) + 8) + b"Exif\0\0" + t
    return b"\xff\xd8" + exif + b"\xff\xc0" + struct.pack(">HBHH", 8, 8, h, w) + b"\0"


def test_media(spark, tmp_path):
    files = {"a.png": png(3, 4), "b.png": png(3, 4), "c.jpg": jpeg(5, 6), "d.jpg": jpeg(5, 6, 6), "e.txt": b"text", "f.png": png(9, 9) + b"\0" * 200, "g.jpg": b"\xff\xd8\xff"}
    for n, d in files.items():
        (tmp_path / n).write_bytes(d)
    got = {r.path.rsplit("/", 1)[1]: (r.media_type, r.width, r.height, r.reject) for r in media.media_records(spark, str(tmp_path), 150).collect()}
    assert got == {
        "a.png": ("image/png", 3, 4, None), "c.jpg": ("image/jpeg", 5, 6, None), "d.jpg": ("image/jpeg", 6, 5, None), "e.txt": (None, None, None, "UNSUPPORTED_TYPE"), "f.png": (None, None, None, "TOO_LARGE"),
        "g.jpg": (None, None, None, "UNSUPPORTED_TYPE"),
    }


def test_detectors(spark):
    rows = [(200, None), (401, None), (402, None), (429, "you have no quota left"), (429, None), (413, None), (500, "x"), (302, None)]
    df = spark.createDataFrame(rows, "c int, b string")
    assert [r[0] for r in df.select(detectors.http_outcome(F.col("c"), F.col("b"))).collect()] == [None, "AUTH_FAILED", "QUOTA_EXCEEDED", "QUOTA_EXCEEDED", "RATE_LIMITED", "INPUT_REJECTED", "PROVIDER_ERROR", "UNEXPECTED_STATUS"]
    j = spark.createDataFrame([('{"a":[{"s":0.25}]}',), ('{"a":[{"s":"0.25"}]}',), ('{"a":[]}',), ("{",), ('{"a":[{"s":null}]}',)], "j string")
    s, e = detectors.response_score(F.col("j"), "a.0.s")
    assert [tuple(r) for r in j.select(s, e).collect()] == [(0.25, None), (None, "SCORE_NOT_A_NUMBER"), (None, "SCORE_MISSING"), (None, "RESPONSE_MALFORMED"), (None, "SCORE_MISSING")]
    n = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (11.0,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in n.select(detectors.normalize_score(F.col("x"), F.lit(0.0), F.lit(10.0), F.lit(False))).collect()] == [1.0, 0.5, 0.0, None, None, None]


def stream(spark, df, path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_job_log_stream(spark, tmp_path):
    rows = [("j1", "queued", "k1", "2026-01-01 00:00:00"), ("j1", "running", "k2", "2026-01-01 00:01:00"), ("j1", "succeeded", "k3", "2026-01-01 00:02:00"), ("j2", "running", "k4", "2026-01-01 00:05:00"), ("j2", "queued", "k5", "2026-01-01 00:04:00"), ("j2", "running", "k4", "2026-01-01 00:05:00")]
    log = spark.createDataFrame(rows, "job string, status string, event string, at string").withColumn("at", F.to_timestamp("at"))
    log.write.parquet(str(tmp_path / "log"))
    source = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    assert stream(spark, jobs.intake(source, "at", ["event"]), tmp_path / "c1", "intake", "append").count() == 5
    got = {r.job: (r.status, r.attempts, r.done) for r in stream(spark, jobs.last_states(source, "job", "status", "at"), tmp_path / "c2", "states", "update").collect()}
    assert got == {"j1": ("succeeded", 1, True), "j2": ("running", 2, False)}
    assert {r.status: r.n for r in stream(spark, jobs.throughput(source, "at", "status"), tmp_path / "c3", "rate", "complete").collect()} == {"queued": 2, "running": 3, "succeeded": 1}


def test_only_ready_providers_run_within_the_budget(spark):
    ran = []

    def make(n, wait=0.0):
        def go():
            ran.append(n)
            time.sleep(wait)
            return spark.createDataFrame([(n,)], "x string")

        return go

    hits, status = corpus.gather(spark, {"a": make("a", 0.3), "off": make("off"), "late": make("late")}, written, {"off": "disabled"}, budget_s=0.2)
    assert ran == ["a"] and [r.x for r in hits.collect()] == ["a"] and {r.provider: r.status for r in status.collect()} == {"a": "ok", "off": "disabled", "late": "skipped"}
    assert corpus.run_status(status) == "partial" and corpus.run_status(status.where("provider <> 'late'")) == "completed"
    with pytest.raises(KeyError):
        corpus.gather(spark, {"mistake": lambda: {}["x"]}, written)


def test_one_bundle_one_file(tmp_path):
    corpus.write_bundle('{"a":"\u00e9"}', tmp_path / "b.json")
    assert (tmp_path / "b.json").read_text(encoding="utf-8") == '{\n  "a": "é"\n}\n' and len(list(tmp_path.iterdir())) == 1


def test_media_that_is_gone(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + bytes(8) + (5).to_bytes(4, "big") * 2
    for i in range(2):
        (tmp_path / f"{i}.png").write_bytes(png + bytes([i]))
    known = written(media.media_records(spark, str(tmp_path)), "media")
    ids = {r.path.rsplit("/", 1)[1]: r.asset_id for r in known.collect()}
    (tmp_path / "1.png").unlink()
    wanted = spark.createDataFrame([(ids["0.png"],), (ids["1.png"],), ("asset_x",), (ids["0.png"],)], "asset_id string")
    assert {r.asset_id: r.state for r in media.resolve(wanted, known, str(tmp_path)).collect()} == {ids["0.png"]: "found", ids["1.png"]: "gone", "asset_x": "unknown"}
    assert media.by_sha256(known, ids["0.png"][6:].upper()).first().asset_id == ids["0.png"]
