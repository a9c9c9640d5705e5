"""Images as content-addressed records, and lookups among them."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 10_000_000


def sniff(data: bytes | None) -> tuple[str | None, int | None, int | None]:
    """Type, width and height of PNG, JPEG and WEBP bytes, JPEG turned as its EXIF says; nulls for others."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return ("image/png", *struct.unpack(">II", data[16:24]))
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            kind = data[12:16]
            if kind == b"VP8X":
                return "image/webp", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
            if kind == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                return "image/webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            return "image/webp", struct.unpack("<H", data[26:28])[0] & 0x3FFF, struct.unpack("<H", data[28:30])[0] & 0x3FFF
        if data[:2] == b"\xff\xd8":
            at, turned = 2, False
            while True:
                marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
                if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                    turned = _orientation(data[at + 10 : at + 2 + size]) >= 5
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return ("image/jpeg", h, w) if turned else ("image/jpeg", w, h)
                at += 2 + size
    except (TypeError, struct.error, IndexError):
        pass
    return None, None, None


def _orientation(tiff: bytes) -> int:
    order = "<" if tiff[:2] == b"II" else ">"
    at = struct.unpack(order + "I", tiff[4:8])[0]
    for i in range(struct.unpack(order + "H", tiff[at : at + 2])[0]):
        tag, _, _, value = struct.unpack(order + "HHIH", tiff[at + 2 + 12 * i : at + 12 + 12 * i])
        if tag == 0x0112:
            return value
    return 1


def media_records(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """`asset_id, sha256, media_type, width, height, byte_size, path, reject` of the files under `path`.

    The same bytes under several names give one record.  Files over the cap or of
    other types are kept with the reason in `reject`.
    """

    @F.arrow_udf("struct<media_type:string,width:int,height:int>")
    def look(v: pa.Array) -> pa.Array:
        rows = [dict(zip(("media_type", "width", "height"), sniff(x), strict=True)) for x in v.to_pylist()]
        return pa.array(rows, pa.struct([("media_type", pa.string()), ("width", pa.int32()), ("height", pa.int32())]))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    df = files.select(F.sha2("content", 256).alias("sha256"), "path", F.col("length").alias("byte_size"), look(F.when(F.col("length") <= max_bytes, F.col("content"))).alias("m"))
    df = df.groupBy("sha256", "byte_size", "m").agg(F.min("path").alias("path"))
    reject: Column = F.when(F.col("byte_size") > max_bytes, "TOO_LARGE").when(F.col("m.media_type").isNull(), "UNSUPPORTED_TYPE")
    return df.select(F.concat(F.lit("asset_"), "sha256").alias("asset_id"), "sha256", "m.media_type", "m.width", "m.height", "byte_size", "path", reject.alias("reject"))


def resolve(wanted: DataFrame, records: DataFrame, root: str, asset_id: str = "asset_id") -> DataFrame:
    """`asset_id, path, state` of each wanted asset (A12): found, gone (known, but its bytes are missing) or unknown.

    The store under `root` is listed once and no content is read.
    """
    known = records.where(F.col("reject").isNull()).select(F.col("asset_id").alias("__id"), "path")
    there = records.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("__path"))
    df = wanted.select(F.col(asset_id).alias("__want")).distinct().join(known, F.col("__want") == F.col("__id"), "left").join(there, F.col("path") == F.col("__path"), "left")
    state = F.when(F.col("__id").isNull(), "unknown").when(F.col("__path").isNull(), "gone").otherwise("found")
    return df.select(F.col("__want").alias("asset_id"), "path", state.alias("state"))


def by_sha256(records: DataFrame, digest: str) -> DataFrame:
    """The record of these bytes, if there is one."""
    return records.where(F.col("sha256") == digest.lower())
