"""Tokenizer and string functions as column expressions, with scalar twins where a query needs them."""

from __future__ import annotations

import re
import string
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates tokens, apart from the hyphen, which also splits words.
SEPARATORS = r"""[ \t\n\x0B\f\r.,;:!?"'()\[\]{}/\\@#$%^&*+=~`<>]+"""
SEPARATORS_AND_HYPHEN = SEPARATORS[:-2] + r"\-]+"


def ascii_lower(text: Column) -> Column:
    """Lower case for A to Z only; other letters keep their case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def ascii_lower_py(text: str) -> str:
    return text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def is_token(word: Column) -> Column:
    """At least two bytes and not only digits."""
    return (F.octet_length(word) >= 2) & ~word.rlike("^[0-9]+$")


def tokens(text: Column) -> Column:
    """Array of the tokens of a text, in order; empty for null and empty texts."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS_AND_HYPHEN), is_token)


_CUT = "".join(c for c in map(chr, range(128)) if re.fullmatch(SEPARATORS_AND_HYPHEN, c)).encode()
_FOLD = bytes.maketrans(string.ascii_uppercase.encode() + _CUT, string.ascii_lowercase.encode() + b" " * len(_CUT))


def word_counts_py(text: bytes, piece: int = 1 << 22) -> Counter[bytes]:
    """How often each piece between separators and hyphens occurs in a text in UTF-8, whether a token or
    not. Long texts are split about every ``piece`` bytes, between words."""
    folded, counts, at = text.translate(_FOLD), Counter(), 0
    while at < len(folded):
        end = folded.find(b" ", at + piece)
        end = len(folded) if end < 0 else end
        counts.update(folded[at:end].split())
        at = end
    return counts


def is_token_py(word: bytes) -> bool:
    return len(word) >= 2 and not word.isdigit()


def token_positions(text: Column) -> Column:
    """Array of ``(text, position)``. Every piece between separators and hyphens takes a position,
    valid or not; of the empty pieces at the end of a chunk one takes none."""
    chunks = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda c: c != "")

    def pieces(c: Column) -> Column:
        p = F.split(c, "-")
        return F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p)

    numbered = F.transform(F.flatten(F.transform(chunks, pieces)), lambda w, i: F.struct(w.alias("text"), i.alias("position")))
    return F.filter(numbered, lambda t: is_token(t.text))


def clean_lines(text: Column) -> Column:
    """Lines with white space collapsed and trimmed, without the blank ones."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)[\s\x1c-\x1f]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def one_line(text: Column) -> Column:
    """Tabs and line feeds as spaces, so that the value fits into a TSV field."""
    return F.translate(text, "\t\n", "  ")


def lenient_int(text: Column) -> Column:
    """Leading integer of a string; 0 where there is none."""
    return F.coalesce(F.regexp_extract(text, r"^[ \t\n\r]*([+-]?[0-9]+)", 1).try_cast("int"), F.lit(0))


def format_size(size: Column) -> Column:
    """Bytes for people, with two decimals (ties to the even one), in units of 1024."""
    return (
        F.when(size >= 1048576, F.format_string("%.2f MB", F.bround(size / 1048576, 2)))
        .when(size >= 1024, F.format_string("%.2f KB", F.bround(size / 1024, 2)))
        .otherwise(F.concat(size.cast("string"), F.lit(" B")))
    )


def strip(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def first_bytes(text: Column, most: int) -> Column:
    """The longest beginning of a text that has at most ``most`` bytes, no character cut in two."""
    b = F.substring(F.encode(text, "UTF-8"), 1, most)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.regexp_replace(F.make_valid_utf8(b.cast("string")), "\ufffd+$", ""))
