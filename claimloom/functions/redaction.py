"""Secrets taken out of headers and JSON bodies before they are logged."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "<redacted>"
# Names whose values are secret, in headers and in bodies (fixed values).
HEADERS = ["authorization", "x-api-key", "apikey", "api-key", "x-auth-token", "cookie", "proxy-authorization", "x-sightengine-secret", "x-copyleaks-key"]
BODY = ["api_secret", "api_key", "apikey", "secret", "token", "password", "access_token"]


def redact_headers(headers: Column) -> Column:
    """A map of headers without secret values; names are compared without case."""
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(HEADERS), MARK).otherwise(v))


def redacted(value: object) -> object:
    if isinstance(value, dict):
        return {k: MARK if k.lower() in BODY else redacted(v) for k, v in value.items()}
    return [redacted(v) for v in value] if isinstance(value, list) else value


def redact_json(text: Column) -> Column:
    """A JSON text without secret values at any depth; what is no JSON is withheld whole, null stays null."""

    def clean(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            return json.dumps(redacted(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return MARK

    @F.arrow_udf(T.StringType())
    def apply(values: pa.Array) -> pa.Array:
        return pa.array([clean(t) for t in values.to_pylist()], pa.string())

    return apply(text)
