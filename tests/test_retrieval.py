import math
import random
import re

from pyspark.sql import functions as F

from claimloom.functions import tokens
from claimloom.operators import fusion, grouping, planner, provenance, ranking, retrieval, store


def test_planner(spark):
    df = spark.createDataFrame([(1, "  Banjir besar di Kota Lama, Banjir dan Hoaks  ", [("a000001", "banjir besar"), ("a000002", " ")]), (2, "di", None), (3, None, None)], "id int, t string, atoms array<struct<atom_id:string,statement:string>>")
    rows = planner.plan_queries(df, "id", "t", "atoms").orderBy("id", "query_id").collect()
    assert [(r.id, r.query_id, r.query, r.variation) for r in rows] == [
        (1, "q001", "Banjir besar di Kota Lama, Banjir dan Hoaks", "caption"), (1, "q002", "Banjir besar Kota Lama Hoaks", "entity"),
        (1, "q003", "Banjir besar Kota Lama Hoaks fakta OR hoaks OR klarifikasi", "fact_check"), (1, "q004", "banjir besar", "atom"), (2, "q001", "di", "caption"),
    ]
    assert rows[3].atom_ids == ["a000001"]


def test_bm25_is_brute_force(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(r.choices(vocab, k=r.randint(0, 25)))) for i in range(60)] + [(60, None), (61, "")]
    queries = [(i, " ".join(r.choices(vocab, k=4))) for i in range(6)] + [(6, "absent"), (7, None)]
    d, q = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(queries, "qid int, t string")
    got = {}
    for x in retrieval.search(q, d, ["qid"], "t", "doc_id", "text", 5).collect():
        got.setdefault(x.qid, []).append((x.rank, x.doc, x.score))
    toks = {i: re.findall(r"\w+", t or "") for i, t in docs}
    avg = sum(map(len, toks.values())) / len(docs)
    for i, t in queries:
        scored = []
        for k, ws in toks.items():
            s = 0.0
            for w in set((t or "").split()):
                if tf := ws.count(w):
                    n = sum(w in v for v in toks.values())
                    s += math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ws) / avg))
            if s:
                scored.append((-round(s, 6), k))
        want = [(n, k, -s) for n, (s, k) in enumerate(sorted(scored)[:5], 1)]
        assert [(a, b) for a, b, _ in sorted(got.get(i, []))] == [(a, b) for a, b, _ in want]


def test_fusion(spark):
    rows = [(1, "a", 1, 1, ["x"]), (1, "a", 2, 3, ["y", "x"]), (1, "b", 1, 2, None), (2, "a", 1, 1, [])]
    df = spark.createDataFrame(rows, "c int, k string, seq int, rank int, atom_ids array<string>").withColumn("tag", F.concat(F.lit("t"), "seq"))
    got = {(r.c, r.k): r.fusion_score for r in fusion.reciprocal_rank_fusion(df, "c", "k", "rank").collect()}
    assert got == {(1, "a"): round(1 / 61 + 1 / 63, 6), (1, "b"): round(1 / 62, 6), (2, "a"): round(1 / 61, 6)}
    merged = {(r.c, r.k): (r.tag, r.atom_ids) for r in fusion.merge_hits(df, "c", "k", ["seq", "rank"], ["tag"]).collect()}
    assert merged[1, "a"] == ("t1", ["x", "y"]) and merged[1, "b"] == ("t1", [])


def test_components_are_union_find(spark):
    r = random.Random(5)
    keys = [f"k{i:03d}" for i in range(120)]
    edges = [(r.choice(keys), r.choice(keys)) for _ in range(70)] + [(keys[i], keys[i + 1]) for i in range(100, 119)]
    root = {k: k for k in keys}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    nodes, e = spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame(edges, "a string, b string")
    got = {x.key: x.root for x in grouping.connected_components(nodes, e).collect()}
    assert got == {k: find(k) for k in keys}
    flipped = spark.createDataFrame([(b, a) for a, b in reversed(edges)], "a string, b string")
    assert {x.key: x.root for x in grouping.connected_components(nodes, flipped).collect()} == got
    assert grouping.connected_components(nodes, e.limit(0)).where("key <> root").count() == 0


def test_groups(spark):
    story = "petugas dinas air memeriksa tanggul utama kota lama sejak pagi buta karena hujan deras belum reda dan warga cemas menunggu kabar resmi"
    docs = [
        ("a", "T", story, "https://one.example/x", None), ("b", "T", story + " hari ini", "https://two.example/y", None), ("c", "U", "teks lain sama sekali", "https://www.two.example/z?utm_source=q", None),
        ("d", "V", "teks lain", "https://two.example/z", None), ("e", "W", None, None, "Pos"), ("f", "X", "pendek", None, "POS"), ("g", None, None, None, None),
    ]
    got = {r.key: r for r in grouping.assign_groups(spark.createDataFrame(docs, "key string, title string, text string, url string, publisher string")).collect()}
    assert got["a"].duplicate_cluster_id == got["b"].duplicate_cluster_id != got["c"].duplicate_cluster_id == got["d"].duplicate_cluster_id
    assert len({got[k].independence_group_id for k in "abcd"}) == 1
    assert got["e"].independence_group_id == got["f"].independence_group_id and got["e"].duplicate_of == []
    assert got["g"].grouping_basis == ["singleton_no_match"] and got["a"].grouping_basis == ["near_duplicate_text"]
    assert got["c"].grouping_basis == ["same_canonical_url", "same_publisher_or_domain"] and got["c"].duplicate_of == ["d"]


def test_near_duplicates_are_brute_force(spark):
    r = random.Random(9)
    base = [[f"t{r.randint(0, 300)}" for _ in range(r.randint(10, 40))] for _ in range(25)]
    docs = [(f"{i}-{j}", " ".join(w if r.random() > 0.03 * j else f"n{r.randint(0, 99)}" for w in b)) for i, b in enumerate(base) for j in range(4)]
    feats = grouping.features(spark.createDataFrame([(k, None, t, None, None) for k, t in docs], "key string, title string, text string, url string, publisher string"))
    sets = {k: {tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for k, t in docs if len(t.split()) >= 12}
    want = {(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}
    assert {(x.a, x.b) for x in grouping.near_duplicate_pairs(feats, hamming_max=None).collect()} == want and want


def test_groups_gate_by_the_rules_hash(spark):
    r = random.Random(11)
    base = [[f"t{r.randint(0, 300)}" for _ in range(r.randint(14, 40))] for _ in range(60)]
    texts = {f"{i:02d}-{j}": [w if r.random() > 0.025 * j else f"n{r.randint(0, 99)}" for w in b] for i, b in enumerate(base) for j in range(4)}
    docs = spark.createDataFrame([(k, "", " ".join(t), None, None) for k, t in texts.items()], "key string, title string, text string, url string, publisher string")
    grams = {k: [" ".join(t[i : i + 4]) for i in range(len(t) - 3)] for k, t in texts.items()}

    def value(gs, digest):
        bits = [sum(1 if int.from_bytes(digest(g.encode()), "big") >> i & 1 else -1 for g in gs) for i in range(64)]
        return sum(1 << i for i, v in enumerate(bits) if v > 0)

    def links(digest):
        h = {k: value(g, digest) for k, g in grams.items()}
        alike = lambda a, b: len(set(grams[a]) & set(grams[b])) >= 0.7 * len(set(grams[a]) | set(grams[b]))
        return {(a, b) for a in texts for b in texts if a < b and alike(a, b) and (h[a] ^ h[b]).bit_count() <= 12}

    want, other = links(tokens.blake2_64), links(tokens.sha256_64)
    assert want - other and other - want
    feats = grouping.features(docs)
    assert {(x.a, x.b) for x in grouping.near_duplicate_pairs(feats, digest=tokens.sha256_64).collect()} == other
    linked = {k: {k} for k in texts}
    for a, b in want:
        if linked[a] is not linked[b]:
            linked[a] |= linked[b]
            for k in linked[b]:
                linked[k] = linked[a]
    got = {x.key: x for x in grouping.assign_groups(docs).collect()}
    assert {k for k, x in got.items() if "near_duplicate_text" in x.grouping_basis} == {k for p in want for k in p}
    same_text = {}
    for k, t in texts.items():
        same_text.setdefault(tuple(t), set()).add(k)
    for ks in same_text.values():
        first = min(ks)
        for k in ks:
            if linked[first] is not linked[k]:
                linked[first] |= linked[k]
                for x in linked[k]:
                    linked[x] = linked[first]
    assert {k: sorted(linked[k] - {k}) for k in texts} == {k: x.duplicate_of for k, x in got.items()}


def test_temporal_and_credibility(spark):
    rows = [("2025-01-01T00:00:00Z",), ("2025-01-01T07:00:00+07:00",), ("2026-01-01T00:00:00+0100",), ("2025-01-01",), ("2025-01-01T00:00:00",), (None,)]
    df = spark.createDataFrame(rows, "p string")
    got = [r.temporal_eligible for r in provenance.temporal(df, "p", provenance.parse_timestamp(F.lit("2025-01-01T00:00:00Z"))).collect()]
    assert got == [True, True, False, None, None, None]
    assert [r.temporal_eligible for r in provenance.temporal(df, "p", F.lit(None).cast("timestamp")).collect()] == [True, True, True, None, None, None]
    c = spark.createDataFrame([("fact_check", "u", "p", "2025-01-01T00:00:00Z", "full"), ("odd", "", None, None, None)], "kind string, url string, pub string, at string, status string")
    assert [r.credibility for r in provenance.credibility(c, "kind", "url", "pub", "at", "status").collect()] == [1.0, round(0.3 / 1.3, 6)]


def test_rerank_and_diversify(spark):
    rows = [(1, 10, "banjir kota", "banjir besar melanda kota", 0.03, "full", "g1"), (1, 11, "", "banjir besar melanda kota", 0.02, "full", "g1"), (1, 12, "", "banjir besar", 0.02, "snippet_only", "g1"), (1, 13, "lain", "cuaca cerah", 0.01, "unavailable", "g2")]
    df = spark.createDataFrame(rows, "c int, k int, title string, text string, fusion_score double, content_status string, g string").withColumns({"credibility": F.lit(None).cast("double"), "temporal_eligible": F.lit(None).cast("boolean"), "q": F.lit("banjir kota")})
    out = ranking.rerank(ranking.feature_columns(df, "c", "q"))
    top = {r.k: r for r in out.collect()}
    assert top[10].f_query_coverage == top[10].f_title_match == top[10].f_fusion_prior == 1.0 and top[12].f_query_coverage == 0.5
    b = top[10].score_breakdown
    assert round(sum(v for k, v in b.items() if k.startswith("contribution.")), 6) == top[10].rerank_score
    assert top[10].relevance_score == round(1 / (1 + math.exp(-top[10].rerank_score)), 6)
    ord_ = out.withColumn("o", F.col("k"))
    places = {r.k: (r.place, r.selected) for r in ranking.diversify(ord_, "c", "k", "g", "o", "text").collect()}
    assert places[10] == (1, True) and places[12] == (4, False) and [k for k, (p, s) in places.items() if not s] == [12]
    assert {r.k for r in ranking.diversify(ord_, "c", "k", "g", "o", "text", limit=1).where("selected").collect()} == {10}


def test_metrics_and_neighbours(spark):
    ranked = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 7, 1)], "q int, d int, rank int")
    rel = spark.createDataFrame([(1, 6), (1, 9), (3, 1)], "q int, d int")
    got = {r.q: (r.precision, r.recall, r.mrr) for r in ranking.judged_metrics(ranked, rel, "q", "d", 2).collect()}
    assert got == {1: (0.5, 0.5, 0.5), 3: (0.0, 0.0, 0.0)}
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "i int, v array<float>")
    rows = ranking.dense_neighbours(v, v.where("i = 0"), "i", "v", 2).orderBy("rank").collect()
    assert [(r.i, r.similarity) for r in rows] == [(1, 1.0), (2, 0.0)]


def test_store(spark):
    old = spark.createDataFrame([("c", 1, "h")], "case_id string, claim_revision int, text_hash string")
    new = spark.createDataFrame([("c", 1, "h"), ("c", 2, "x"), ("d", 1, "a"), ("d", 1, "b"), ("c", 1, "h")], old.schema)
    assert {(r.case_id, r.claim_revision): r.action for r in store.upsert_revisions(old, new).collect()} == {("c", 1): "keep", ("c", 2): "insert", ("d", 1): "conflict"}
    jobs = spark.createDataFrame([(1, "running", 5, 3), (2, "running", 5, 1), (3, "running", 50, 1), (4, "queued", 5, 1)], "j int, status string, lease_expires_at int, attempts int")
    assert {r.j: r.status for r in store.recover_leases(jobs, F.lit(10)).collect()} == {1: "failed", 2: "queued", 3: "running", 4: "queued"}
    assert [r.j for r in store.claim_order(jobs, "lease_expires_at", "j", 2).orderBy("place").collect()] == [1, 2]
