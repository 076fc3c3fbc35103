"""Parts of addresses (I24) and of JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Second-level labels under which names are registered (fixed values).
SECOND_LEVEL = ("co", "com", "org", "net", "gov", "ac")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def host(url: Column | str) -> Column:
    """The lower-case host of a URL, without port or user; null where there is none."""
    h = F.regexp_extract(F.lower(_col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.when(h != "", h)


def registrable_domain(of_host: Column | str) -> Column:
    """The last two labels of a host, or three where the last but one is a registry's own."""
    labels = F.split(_col(of_host), r"\.")
    n = F.size(labels)
    three = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, -2).isin(*SECOND_LEVEL)
    return F.when(n < 2, _col(of_host)).when(three, F.concat_ws(".", F.slice(labels, -3, 3))).otherwise(F.concat_ws(".", F.slice(labels, -2, 2)))


def query_value(url: Column | str, key: str) -> Column:
    """The first value of a query key, as written; null without it."""
    v = F.regexp_extract(_col(url), rf"[?&]{key}=([^&#]*)", 1)
    return F.when(_col(url).rlike(rf"[?&]{key}="), v)


def json_at(x: Column | str, path: str, kind: str) -> Column:
    """A typed value at a JSON path; null where absent or of another type."""
    return F.try_variant_get(F.try_parse_json(_col(x)), path, kind)
