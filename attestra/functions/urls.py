"""URL normal forms and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^;?#]*)"


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, path without trailing slashes, nothing after it; empty where there is no host."""
    part = lambda i: F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, i)
    return F.when(part(2) == "", F.lit("")).otherwise(F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.regexp_replace(part(3), "/+$", "")))


def domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), r"^www\.", "")


def cache_key(hashes: Column, url: Column, title: Column) -> Column:
    """sha256 of sorted hashes, normal url and collapsed title, joined by bars."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[ \t\n\r\f]+", " "))
    return F.sha2(F.concat_ws("|", F.array_join(F.array_sort(hashes), "|"), normalize_url(url), words), 256)
