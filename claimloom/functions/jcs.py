"""Canonical JSON (RFC 8785), strict parsing and content-derived ids."""

from __future__ import annotations

import hashlib
import json
import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAFE_INT = (1 << 53) - 1


class NotCanonical(ValueError):
    """A value that canonical JSON cannot hold."""


def _pairs(items: list[tuple[str, object]]) -> dict:
    if len({k for k, _ in items}) < len(items):
        raise NotCanonical("a key occurs twice")
    return dict(items)


def _constant(name: str) -> None:
    raise NotCanonical(f"{name} is no JSON number")


def parse_strict(data: str | bytes) -> object:
    """JSON without a byte order mark, repeated keys, NaN or infinities."""
    if isinstance(data, bytes):
        if data.startswith(b"\xef\xbb\xbf"):
            raise NotCanonical("it begins with a byte order mark")
        data = data.decode("utf-8")
    return json.loads(data, object_pairs_hook=_pairs, parse_constant=_constant)


def number(x: float) -> str:
    """A number as ECMAScript writes it: shortest digits, plain from 1e-6 to below 1e21."""
    if isinstance(x, int):
        if abs(x) > SAFE_INT:
            raise NotCanonical("an integer beyond 2^53 - 1")
        return str(x)
    if not math.isfinite(x):
        raise NotCanonical("a number that isn't finite")
    if x == 0:
        return "0"
    mantissa, _, exp = f"{abs(x)!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(exp or 0) - (len(whole + part) - len(digits))
    digits = digits.rstrip("0")
    sign, n = "-" if x < 0 else "", len(digits)
    if 0 < point <= 21:
        body = digits + "0" * (point - n) if n <= point else f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        body = "0." + "0" * -point + digits
    else:
        e = point - 1
        body = digits[0] + ("." + digits[1:] if n > 1 else "") + f"e{'+' if e > 0 else '-'}{abs(e)}"
    return sign + body


def _string(s: str) -> str:
    if any("\ud800" <= c <= "\udfff" for c in s):
        raise NotCanonical("half of a surrogate pair")
    return json.dumps(s, ensure_ascii=False)


def canonical_json(v: object) -> str:
    if v is None or v is True or v is False:
        return {None: "null", True: "true", False: "false"}[v]
    if isinstance(v, str):
        return _string(v)
    if isinstance(v, (int, float)):
        return number(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canonical_json, v)) + "]"
    if isinstance(v, dict):
        order = sorted(v.items(), key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{_string(k)}:{canonical_json(x)}" for k, x in order) + "}"
    raise NotCanonical(f"{type(v).__name__} has no JSON form")


def canonical_atoms(atoms: list[dict], keep: tuple[str, ...] | None = None) -> list[dict]:
    """Atoms by id, their dependencies and spans in order, other keys left out."""
    out = []
    for a in sorted(atoms, key=lambda a: a["atom_id"]):
        a = {k: x for k, x in a.items() if keep is None or k in keep}
        if "depends_on" in a:
            a["depends_on"] = sorted(a["depends_on"])
        if "spans" in a:
            a["spans"] = sorted(a["spans"], key=lambda s: (s["start"], s["end"]))
        out.append(a)
    return out


def content_id(prefix: str, value: object) -> str:
    return prefix + hashlib.sha256(canonical_json(value).encode()).hexdigest()


def canonical_column(col: Column) -> Column:
    """Canonical form of a JSON text column; null where it is malformed or cannot be canonical."""

    @F.arrow_udf(T.StringType())
    def apply(v: pa.Array) -> pa.Array:
        out = []
        for x in v.to_pylist():
            try:
                out.append(None if x is None else canonical_json(parse_strict(x)))
            except ValueError:
                out.append(None)
        return pa.array(out, pa.string())

    return apply(col)
