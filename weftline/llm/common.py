"""What the corpus operators share: written stages, guarded broadcasts, site names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources.staging import materialize, row_bytes, shared_dir  # noqa: F401 - handed on to the operators

#: Tables of unproven size are broadcast up to so many bytes of rows.
BROADCAST_BYTES = 16 << 20


def fits_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether a table's rows hold at most ``most`` bytes, arrays and strings counted by their lengths. Give it a written table."""
    return (df.agg(F.sum(row_bytes(df.schema)).alias("n")).first()["n"] or 0) <= most


def guarded_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it fits, else as it is (shuffle join)."""
    return F.broadcast(df) if fits_broadcast(df, most) else df


def site_of(url: Column) -> Column:
    """Host of an address in lower case, without port, user part and leading ``www.``; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def letters_of(text: Column) -> Column:
    """The letters of a text in order, lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}]+", "")


def page_lines(content: Column) -> Column:
    """Content split at every line feed; line numbers count from 0."""
    return F.split(content, "\n", -1)
