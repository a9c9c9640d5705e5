"""The job log as a stream: idempotent intake, last states, throughput (K4, K8; an addition to the batch operators)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TERMINAL = ("succeeded", "failed", "partial")


def intake(log: DataFrame, at: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first event of each key within the watermark; replays are dropped."""
    return log.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def throughput(log: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and kind, windows closed by the watermark."""
    counted = log.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def last_states(log: DataFrame, job: str, status: str, at: str) -> DataFrame:
    """`job, status, attempts, done` after each batch, out-of-order events included, state kept per job."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        when, last, attempts = state.get if state.exists else (-1, "", 0)
        for b in batches:
            for s, t in zip(b[status], b[at], strict=True):
                t = pd.Timestamp(t).value // 1000
                attempts += s == "running"
                if t >= when:
                    when, last = t, s
        state.update((int(when), last, int(attempts)))
        yield pd.DataFrame({job: [key[0]], "status": [last], "attempts": [attempts], "done": [last in TERMINAL]})

    kind = dict(log.dtypes)[job]
    return log.groupBy(job).applyInPandasWithState(advance, f"{job} {kind}, status string, attempts long, done boolean", "at long, status string, attempts long", "update", GroupStateTimeout.NoTimeout)
