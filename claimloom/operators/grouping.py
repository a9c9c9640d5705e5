"""Duplicate clusters and independence groups."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.python_text import normalized_text_hash
from ..functions.text import is_blank
from ..functions.tokens import blake2_64, content_tokens, hamming, shingles, simhash
from ..functions.urls import canonical_url, registrable_domain
from ..session import dropped, written

HAMMING_MAX, JACCARD_MIN, SHINGLE, MIN_TOKENS = 12, 0.7, 4, 12


def features(docs: DataFrame) -> DataFrame:
    """`key, canonical, domain, text_hash, publisher_fold, n_tokens, grams` of `key, title, text, url, publisher` (F1)."""
    tokens = content_tokens(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    df = docs.select(
        "key", canonical_url(F.col("url")).alias("canonical"), registrable_domain(F.col("url")).alias("domain"),
        normalized_text_hash(F.when(~is_blank(F.col("text")), F.col("text"))).alias("text_hash"), F.lower("publisher").alias("publisher_fold"), tokens.alias("toks"),
    )
    return df.withColumn("n_tokens", F.size("toks")).withColumn("grams", shingles(F.col("toks"), SHINGLE)).drop("toks")


def star_edges(df: DataFrame, key: str, by: str, basis: str) -> DataFrame:
    """Edges from each row to the smallest key with the same `by`: as connected as all pairs, but linear."""
    some = df.where(F.col(by).isNotNull()).select(F.col(key).alias("b"), F.col(by).alias("by"))
    heads = some.groupBy("by").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1")
    return some.join(heads.select("by", "a"), "by").where("a <> b").select("a", "b", F.lit(basis).alias("basis"))


def near_duplicate_pairs(feats: DataFrame, jaccard_min: float = JACCARD_MIN, hamming_max: int | None = HAMMING_MAX, digest: Callable[[bytes], bytes] = blake2_64) -> DataFrame:
    """`a, b, overlap, size_sum` of rows whose shingle sets are alike (F4), by an exact prefix join.

    Shingles are hashed to 64 bits in the projection that reads them, so only
    numbers are shuffled.  One that a single row has can't be shared: it counts in
    the row's size and goes no further.  Under one order (rare shingles first) two
    alike sets share one of their first shingles, so only those are joined; sizes
    and the shared position rule out most pairs before the sets are compared.
    `hamming_max` also asks for near similarity hashes, made with `digest`, of the
    rows that are in a pair; None leaves that gate out.  The rule's digest is
    BLAKE2b; SHA-256 is for results that SQL must repeat.
    """
    t = int(round(jaccard_min * 100))
    own = feats.where(F.col("n_tokens") >= MIN_TOKENS)
    base = own.select("key", F.array_distinct(F.transform("grams", lambda g: F.xxhash64(g))).alias("set"))
    base = written(base.select("key", F.size("set").alias("n"), "set"), "sets")
    rows = base.select("key", "n", F.explode("set").alias("g"))
    counts = rows.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    kept = rows.join(counts, "g").groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("kept"))
    # Positions count the shingles left out, which come first.
    kept = kept.withColumn("first", F.col("n") - F.size("kept")).withColumn("upto", F.col("n") - F.ceil(F.col("n") * t / 100.0 - 1e-9) + 1 - F.col("first"))
    prefix = kept.where("upto > 0").select("key", "n", "first", F.posexplode(F.slice("kept", F.lit(1), F.col("upto").cast("int"))).alias("at", "e"))
    prefix = written(prefix.select("key", "n", F.col("e.g").alias("g"), (F.col("first") + F.col("at") + 1).alias("pos")), "prefix")
    x, y = prefix.alias("x"), prefix.alias("y")
    least = (F.col("x.n") + F.col("y.n")) * (t / (100.0 + t)) - 1e-9
    room = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) + 1
    pairs = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.key") < F.col("y.key")) & (room >= least)).select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
    pairs = written(pairs, "pairs")
    some = base.join(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "key", "left_semi")
    both = pairs.join(some.select(F.col("key").alias("a"), F.col("set").alias("sa")), "a").join(some.select(F.col("key").alias("b"), F.col("set").alias("sb")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("overlap"), (F.size("sa") + F.size("sb")).alias("size_sum"))
    both = both.where(F.col("overlap") * 100 >= (F.col("size_sum") - F.col("overlap")) * t)
    if hamming_max is None:
        return both
    both = written(both, "alike")
    asked = both.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    h = written(simhash(own.join(asked, "key", "left_semi").select("key", "grams"), "key", "grams", digest), "simhash")
    both = both.join(h.select(F.col("key").alias("a"), F.col("hi").alias("ha"), F.col("lo").alias("la")), "a")
    both = both.join(h.select(F.col("key").alias("b"), F.col("hi").alias("hb"), F.col("lo").alias("lb")), "b")
    return both.where(hamming(F.col("ha"), F.col("hb")) + hamming(F.col("la"), F.col("lb")) <= hamming_max).select("a", "b", "overlap", "size_sum")


def connected_components(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """`key, root`: the smallest key each key is linked to.

    Large-star and small-star rounds until no edge changes: every round is two
    aggregations, a hub's edges shrink to a star, and no component is ever held
    in one place.  Each round is written, so a lost executor costs one round.
    Components of a round that still changes are never returned: it is an error
    if `rounds` do not suffice.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct(), "edges")
        # Sets of edges of one size are equal if nothing is in one alone.
        changed = now.count() != e.count() or not now.join(e, ["u", "v"], "left_anti").isEmpty()
        dropped(e)
        e = now
        if not changed:
            break
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    roots = e.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.select("key").distinct().join(roots, F.col("key") == F.col("u"), "left").select("key", F.coalesce("root", "key").alias("root"))


def stable_ids(components: DataFrame, prefix: str) -> DataFrame:
    """`key, root, group_id`: an id made of the component's members in order.

    Members stream through a digest in sorted order, so a component of any size
    takes the memory of one row; a task meets whole components.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, running = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([root], pa.string()), pa.array([f"{prefix}_{running.hexdigest()[:24]}"], pa.string())], names=["root", "group_id"])

        for b in batches:
            for r, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if running is not None and r == root:
                    running.update(b"\x1f" + k.encode("utf-8", "surrogatepass"))
                else:
                    if running is not None:
                        yield done()
                    root, running = r, hashlib.sha256(k.encode("utf-8", "surrogatepass"))
        if running is not None:
            yield done()

    members = components.select("root", "key").repartition("root").sortWithinPartitions("root", "key")
    return components.join(members.mapInArrow(digest, "root string, group_id string"), "root")


def assign_groups(docs: DataFrame, siblings: bool = True) -> DataFrame:
    """`key, duplicate_cluster_id, independence_group_id, duplicate_of, grouping_basis` of every key (F1-F8).

    `duplicate_of` lists a key's siblings, n - 1 for each of n members, as the
    record asks; where clusters may be large leave them out with `siblings=False`
    and join on the cluster id.
    """
    made = features(docs)  # shingles are many times a text: they are hashed where they are made and never written
    feats = written(made.drop("grams"), "features")
    outlet = feats.withColumn("outlet", F.coalesce("domain", F.when(F.coalesce("publisher_fold", F.lit("")) != "", F.concat(F.lit("publisher:"), "publisher_fold"))))
    same = star_edges(feats, "key", "canonical", "same_canonical_url").unionByName(star_edges(feats, "key", "text_hash", "exact_text_hash"))
    same = written(same.unionByName(near_duplicate_pairs(made).select("a", "b", F.lit("near_duplicate_text").alias("basis"))), "links")
    linked = same.unionByName(star_edges(outlet, "key", "outlet", "same_publisher_or_domain"))
    keys = feats.select("key")
    dup = written(stable_ids(connected_components(keys, same), "dc"), "clusters")
    ind = stable_ids(connected_components(keys, linked), "ig").select("key", F.col("group_id").alias("independence_group_id"))
    basis = linked.select(F.explode(F.array("a", "b")).alias("key"), "basis").groupBy("key").agg(F.array_sort(F.collect_set("basis")).alias("basis"))
    out = dup.join(ind, "key").join(basis, "key", "left").withColumn("grouping_basis", F.coalesce("basis", F.array(F.lit("singleton_no_match"))))
    ids = ["key", F.col("group_id").alias("duplicate_cluster_id"), "independence_group_id"]
    if not siblings:
        return out.select(*ids, "grouping_basis")
    members = dup.groupBy("root").agg(F.array_sort(F.collect_set("key")).alias("m"))
    return out.join(members, "root").select(*ids, F.array_except("m", F.array("key")).alias("duplicate_of"), "grouping_basis")


def dedup_effectiveness(assignments: DataFrame) -> DataFrame:
    """Items, clusters, groups and how far each reduces the items (F9); zeros for no items."""
    n, c, g = F.count_distinct("key"), F.count_distinct("duplicate_cluster_id"), F.count_distinct("independence_group_id")
    one = lambda x: F.coalesce(F.round(1 - x / F.nullif(n, F.lit(0)), 6), F.lit(0.0))
    return assignments.agg(n.alias("items"), c.alias("duplicate_clusters"), g.alias("independence_groups"), one(c).alias("duplicate_reduction_ratio"), one(g).alias("independence_reduction_ratio"))
