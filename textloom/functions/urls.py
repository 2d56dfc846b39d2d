"""URL normalisation and content hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, without parameters of the last segment, query, fragment and
    trailing slashes; the path keeps its letter case. Null stays null."""
    u = F.translate(F.ltrim(url, F.lit("".join(map(chr, range(33))))), "\t\r\n", "")
    scheme = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"
    head = F.regexp_extract(u, scheme + r"(?://[^/?#]+)?", 0)
    path = F.regexp_extract(u, scheme + r"(?://[^/?#]*)?([^?#]*)", 1)
    # the parameters of the last segment and the slashes before them, or at the end
    return F.concat(F.lower(head), F.regexp_replace(path, r"/*(?:;[^/]*)?$", ""))


def content_hash(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def stored_hash(stored: Column, text: Column) -> Column:
    """The hash as stored, trimmed and in lower case; where it is missing or blank, that of the text."""
    h = F.lower(F.regexp_replace(stored, r"^\s+|\s+$", ""))
    return F.when(h != "", h).otherwise(content_hash(text))


def epoch_seconds(t: Column) -> Column:
    """Epoch seconds of a value that may be in milliseconds."""
    return F.when(t > 10**12, t / 1000.0).otherwise(t.cast("double"))
