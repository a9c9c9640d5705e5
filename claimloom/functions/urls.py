"""Canonical addresses and registrable domains as Arrow UDFs."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import parse_qsl, urlencode, urlsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query parameters that only track the reader (fixed values).
TRACKING = frozenset(
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id gclid fbclid igshid mc_cid mc_eid "
    "ref referrer spm share amp at_medium at_campaign __twitter_impression".split()
)
# Public suffixes of two labels (fixed values).
TWO_PART_SUFFIXES = frozenset(
    "co.id or.id web.id go.id ac.id sch.id my.id biz.id co.uk org.uk ac.uk com.au com.br com.sg com.my".split()
)
_DEFAULT_PORT = {"http": 80, "https": 443}


def canonical(url: str | None) -> str | None:
    """The comparable form of an http(s) address, or null for anything else.

    Scheme and host lower-case, without user, leading `www.`, default port,
    fragment, tracking parameters and closing slashes; parameters sorted and
    encoded anew.  An impossible port gives null.
    """
    try:
        u = urlsplit((url or "").strip())
        port = u.port
    except ValueError:
        return None
    scheme = u.scheme.lower()
    if scheme not in _DEFAULT_PORT or not u.netloc:
        return None
    site = (u.hostname or "").lower().removeprefix("www.")
    if port and port != _DEFAULT_PORT[scheme]:
        site += f":{port}"
    kept = [kv for kv in parse_qsl(u.query, keep_blank_values=True) if kv[0].lower() not in TRACKING]
    tail = "?" + urlencode(sorted(kept)) if kept else ""
    return f"{scheme}://{site}{u.path.rstrip('/') or '/'}{tail}"


def domain(url: str | None) -> str | None:
    """The last two labels of the host, three under a two-part suffix; null without a host."""
    try:
        host = urlsplit((url or "").strip()).hostname
    except ValueError:
        return None
    host = (host or "").lower().rstrip(".").removeprefix("www.")
    if not host:
        return None
    labels = host.split(".")
    return ".".join(labels[-3:] if ".".join(labels[-2:]) in TWO_PART_SUFFIXES else labels[-2:])


def _column(f: Callable[[str | None], str | None]) -> Callable[[Column], Column]:
    @F.arrow_udf(T.StringType())
    def apply(values: pa.Array) -> pa.Array:
        return pa.array([f(v) for v in values.to_pylist()], pa.string())

    return apply


def canonical_url(col: Column) -> Column:
    return _column(canonical)(col)


def registrable_domain(col: Column) -> Column:
    return _column(domain)(col)
