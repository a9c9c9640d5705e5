"""Corpora in line-delimited JSON, provider status and isolation, profiles and sinks (A1-A10)."""

from __future__ import annotations

import json
import time
import tomllib
from collections.abc import Callable
from pathlib import Path
from typing import Protocol, runtime_checkable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ["id", "title", "text", "url", "publisher", "language", "published_at", "kind"]
_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS] + [T.StructField("_corrupt", T.StringType())])
STATUS_SCHEMA = "provider string, capability string, status string, message string"


def read_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """`(records, rejected)` of a UTF-8 file of one JSON object per line.

    Blank lines are skipped.  Malformed lines, NaN and infinities are rejected
    with their text, never guessed at.  The schema is given, so nothing is inferred.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", _SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowNonNumericNumbers": "false"}).alias("r"))
    bad = F.col("r._corrupt").isNotNull() | F.try_parse_json("value").isNull()
    return parsed.where(~bad).select("r.*").drop("_corrupt"), parsed.where(bad).select(F.col("value").alias("line"))


def capability(corpus: DataFrame, provider: str = "local_corpus") -> DataFrame:
    """One status row: ok with the number of documents, or unconfigured for none (A2)."""
    return corpus.agg(F.count("*").alias("n")).select(
        F.lit(provider).alias("provider"), F.lit("local_corpus_search").alias("capability"), F.when(F.col("n") > 0, "ok").otherwise("unconfigured").alias("status"),
        F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" documents"))).otherwise("no corpus").alias("message"),
    )


@runtime_checkable
class SearchProvider(Protocol):
    """A source of hits for planned queries (A3): all queries at once, at most `limit` hits each."""

    name: str

    def capability(self) -> str: ...

    def search(self, queries: DataFrame, limit: int) -> DataFrame: ...


@runtime_checkable
class FactCheckProvider(Protocol):
    """A source of fact checks (A4) for `claim, language, as_of`."""

    name: str

    def capability(self) -> str: ...

    def search(self, claims: DataFrame, limit: int) -> DataFrame: ...


@runtime_checkable
class ImageProvenanceProvider(Protocol):
    """A source of earlier appearances (A5) for `image_sha256, query_context` rows."""

    name: str

    def capability(self) -> str: ...

    def search(self, images: DataFrame, limit: int) -> DataFrame: ...


def gather(
    spark: SparkSession, providers: dict[str, Callable[[], DataFrame]], materialize: Callable[[DataFrame, str], DataFrame], ready: dict[str, str] | None = None, budget_s: float | None = None
) -> tuple[DataFrame | None, DataFrame]:
    """`(hits, status)` over providers; one that fails is reported and left out.

    Only providers whose status in `ready` is `ok` (the default) run.  A plan only
    fails when it runs, so each provider's hits are materialised on their own;
    messages are cut at 500 characters.  What Spark reports, and what a provider
    raises for a missing file or a refused connection, is that provider's failure;
    mistakes in the program are not, and are raised.  Before each provider the time
    is looked at: beyond `budget_s` the rest are skipped, which makes the run
    partial (D7).
    """
    began, hits, rows = time.monotonic(), None, []
    for name, make in providers.items():
        state = (ready or {}).get(name, "ok")
        if state != "ok":
            rows.append((name, "search", state, "not run"))
            continue
        if budget_s is not None and time.monotonic() - began >= budget_s:
            rows.append((name, "search", "skipped", "time budget exhausted"))
            continue
        try:
            own = materialize(make().withColumn("provider", F.lit(name)), f"hits-{name}")
        except (PySparkException, Py4JError, OSError, RuntimeError) as e:
            rows.append((name, "search", "failed", str(e)[:500]))
            continue
        hits = own if hits is None else hits.unionByName(own, allowMissingColumns=True)
        rows.append((name, "search", "ok", ""))
    return hits, spark.createDataFrame(rows, STATUS_SCHEMA)


def search_all(spark: SparkSession, providers: list[SearchProvider], queries: DataFrame, limit: int, materialize: Callable[[DataFrame, str], DataFrame], budget_s: float | None = None) -> tuple[DataFrame | None, DataFrame]:
    """Every query against every provider that says it is ready."""
    makes = {p.name: (lambda p=p: p.search(queries, limit)) for p in providers}
    return gather(spark, makes, materialize, {p.name: p.capability() for p in providers}, budget_s)


def run_status(status: DataFrame) -> str:
    """`partial` if a provider failed or was skipped, else `completed`."""
    return "completed" if status.where(F.col("status").isin("failed", "skipped")).isEmpty() else "partial"


def load_profiles(path: str | Path) -> dict[str, dict]:
    """Detector profiles of a TOML file as `modality:name` (A9); a missing or bad file gives none."""
    try:
        data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, tomllib.TOMLDecodeError):
        return {}
    rows = data.get("detectors", [])
    rows = rows if isinstance(rows, list) else [r | {"name": n} for n, r in rows.items()]
    return {f"{r.get('modality')}:{r.get('name')}": r for r in rows if isinstance(r, dict)}


def write_bundle(bundle: str, path: str | Path) -> None:
    """One bundle as a file of its own, indented, written whole or not at all (A10)."""
    at = Path(path)
    part = at.with_name(at.name + ".part")
    part.write_text(json.dumps(json.loads(bundle), ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    part.replace(at)


def write_bundles(bundles: DataFrame, path: str, column: str = "bundle") -> None:
    """One JSON object per line, non-ASCII kept as it is (A10)."""
    bundles.select(F.to_json(column).alias("value")).write.mode("overwrite").text(path)
