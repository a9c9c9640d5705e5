"""Merging hits to candidates and fusing ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RRF_K = 60


def merge_hits(hits: DataFrame, claim: str, key: str, order: list[str], attributes: list[str]) -> DataFrame:
    """One row per (claim, key): attributes of the first hit, ordered union of `atom_ids`."""
    first = F.min_by(F.struct(*attributes), F.struct(*order))
    atoms = F.array_sort(F.array_distinct(F.flatten(F.collect_set("atom_ids")))) if "atom_ids" in hits.columns else None
    out = [first.alias("f"), F.count("*").alias("n_hits")] + ([atoms.alias("atom_ids")] if atoms is not None else [])
    merged = hits.groupBy(claim, key).agg(*out)
    return merged.select(claim, key, "f.*", "n_hits", *(["atom_ids"] if atoms is not None else []))


def reciprocal_rank_fusion(hits: DataFrame, claim: str, key: str, rank: str, k: int = RRF_K) -> DataFrame:
    """`claim, key, fusion_score`: sum of 1 / (k + rank) over all lists, ranks from 1."""
    return hits.groupBy(claim, key).agg(F.round(F.sum(1 / (k + F.col(rank))), 6).alias("fusion_score"))
