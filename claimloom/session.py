"""Session, table and checkpoint helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the plans are written for."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("claimloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores, where a scan has fewer splits than there are cores (small single files)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session, or what `setCheckpointDir` set.

    Only where neither is set (local tests) a temporary folder is made; on a
    cluster that is an error, since other machines would not see it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("claimloom.local.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="claimloom-")
    spark.conf.set("claimloom.local.dir", at)
    return at


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> None:
    """Appends `df` to `path`; shuffle files of the write are let go of as soon as it has ended."""
    spark = df.sparkSession
    was = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.mode("append").parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if was is None else spark.conf.set(_CLEAN, was)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes `df` to the shared folder once and reads it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_in_parts(source: DataFrame, make: Callable[[DataFrame], DataFrame], name: str, parts: int) -> DataFrame:
    """Writes `make(source)`, a few files of a written `source` at a time, and deletes each part of `source` once it is done with.

    `make` must treat rows one by one.  All parts together are in the result.
    """
    spark = source.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files = sorted(source.inputFiles())
    schema = make(source).schema
    for k in range(parts):
        own = files[k::parts]
        if own:
            _write(make(spark.read.schema(source.schema).parquet(*own)), path)
            for f in own:
                _delete(spark, f)
    if not files:
        _write(make(source), path)
    return spark.read.schema(schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*frames: DataFrame) -> None:
    """Deletes what `written` wrote, once nothing reads it any more."""
    for df in frames:
        files = df.inputFiles()
        if files:
            _delete(df.sparkSession, files[0].rsplit("/", 1)[0])
