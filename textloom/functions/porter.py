"""The Porter stemmer (rule set of 1980).

Words are stemmed once each: the function runs over the distinct vocabulary, in Arrow batches, and
its result is joined back. The same rules, written down again as SQL, are the oracle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The suffixes of steps 2 to 4 and what replaces them.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _any(suffixes) -> str:
    return "(" + "|".join(suffixes) + ")$"


_RE2, _RE3, _RE4 = (re.compile(_any(s)) for s in (STEP2, STEP3, STEP4))


def shape(word: str) -> str:
    """A ``v`` or ``c`` for each byte: y is a vowel after a consonant; all but letters are consonants."""
    out = ""
    for ch in word:
        vowel = ch in "aeiou" or ch == "y" and out[-1:] == "c"
        out += "v" if vowel else "c" * len(ch.encode("utf-8", "replace"))
    return out


def measure(word: str) -> int:
    return shape(word).count("vc")


def _cvc(word: str) -> bool:
    return shape(word).endswith("cvc") and word[-1] not in "wxy"


def stem(word: str) -> str:
    """Stem of a word in lower case; words of up to 2 or above 500 bytes stay as they are."""
    if not 2 < len(word.encode("utf-8", "replace")) <= 500:
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = next((s for s in ("eed", "ed", "ing") if w.endswith(s)), "")
    if cut == "eed":
        w = w[:-1] if measure(w[:-1]) > 0 else w
    elif cut and "v" in shape(w[: -len(cut)]):
        w = w[: -len(cut)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and shape(w)[-1] == "c":
            w = w if w[-1] in "lsz" else w[:-1]
        elif measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    for pattern, table in ((_RE2, STEP2), (_RE3, STEP3)):
        if (m := pattern.search(w)) and measure(w[: m.start()]) > 0:
            w = w[: m.start()] + table[m[0]]
    if (m := _RE4.search(w)) and measure(w[: m.start()]) > 1 and (m[0] != "ion" or w[: m.start()].endswith(("s", "t"))):
        w = w[: m.start()]
    if len(w) > 1 and w.endswith("e"):
        m1 = measure(w[:-1])
        if m1 > 1 or m1 == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def _stages() -> list[dict[str, str]]:
    """Columns to add one after the other to a table with the column ``w``; the stem ends in ``w9``."""

    def sub(x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"

    def mask(x: str) -> str:
        y = sub(f"replace({sub(x, '(^|[aeiou])y', '\\1Y')}, 'yy', 'yY')", "[^ -~]", "cc")
        return sub(sub(sub(y, "[aeiouy]", "!"), "[^!]", "c"), "!", "v")

    def m(k: str) -> str:
        return f"((length({k}) - length(replace({k}, 'vc', ''))) // 2)"

    def chop(x: str, n: int) -> str:
        return f"substr({x}, 1, length({x}) - {n})"

    def last(x: str, n: int) -> str:
        return f"right({x}, {n})"

    def cvc(x: str, k: str) -> str:
        return f"(right({k}, 3) = 'cvc' AND right({x}, 1) NOT IN ('w', 'x', 'y'))"

    def replaced(w: str, s: str, k: str, table: dict[str, str]) -> str:
        cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items())
        return f"CASE WHEN {s} <> '' AND {m(k)} > 0 THEN concat(substr({w}, 1, length({w}) - length({s})), CASE {s} {cases} END) ELSE {w} END"

    def suffix(w: str, table) -> str:
        return f"regexp_extract({w}, '{_any(table)}', 1)"

    def rest(w: str, s: str) -> str:
        return mask(f"substr({w}, 1, length({w}) - length({s}))")

    return [
        {"w1": f"CASE WHEN {last('w', 4)} = 'sses' OR {last('w', 3)} = 'ies' THEN {chop('w', 2)} WHEN {last('w', 1)} = 's' AND {last('w', 2)} <> 'ss' THEN {chop('w', 1)} ELSE w END"},
        {"cut": f"CASE WHEN {last('w1', 3)} = 'eed' THEN 1 WHEN {last('w1', 2)} = 'ed' THEN 2 WHEN {last('w1', 3)} = 'ing' THEN 3 ELSE 0 END"},
        {"cut_w": "substr(w1, 1, length(w1) - cut)"},
        {"cut_k": mask("cut_w")},
        {
            "w2": f"CASE WHEN cut = 1 THEN CASE WHEN {m('cut_k')} > 0 THEN cut_w ELSE w1 END WHEN cut = 0 OR instr(cut_k, 'v') = 0 THEN w1 "
            f"WHEN {last('cut_w', 2)} IN ('at', 'bl', 'iz') THEN concat(cut_w, 'e') "
            f"WHEN length(cut_w) > 1 AND right(cut_w, 1) = substr(cut_w, length(cut_w) - 1, 1) AND right(cut_k, 1) = 'c' THEN CASE WHEN right(cut_w, 1) IN ('l', 's', 'z') THEN cut_w ELSE {chop('cut_w', 1)} END "
            f"WHEN {m('cut_k')} = 1 AND {cvc('cut_w', 'cut_k')} THEN concat(cut_w, 'e') ELSE cut_w END"
        },
        {"k3": mask(chop("w2", 1))},
        {"w3": f"CASE WHEN right(w2, 1) = 'y' AND instr(k3, 'v') > 0 THEN concat({chop('w2', 1)}, 'i') ELSE w2 END"},
        {"s4": suffix("w3", STEP2)},
        {"k4": rest("w3", "s4")},
        {"w4": replaced("w3", "s4", "k4", STEP2)},
        {"s5": suffix("w4", STEP3)},
        {"k5": rest("w4", "s5")},
        {"w5": replaced("w4", "s5", "k5", STEP3)},
        {"s6": suffix("w5", STEP4)},
        {"c6": "substr(w5, 1, length(w5) - length(s6))"},
        {"k6": mask("c6")},
        {"w6": f"CASE WHEN s6 <> '' AND {m('k6')} > 1 AND (s6 <> 'ion' OR right(c6, 1) IN ('s', 't')) THEN c6 ELSE w5 END"},
        {"c7": chop("w6", 1)},
        {"k7": mask("c7")},
        {"w7": f"CASE WHEN length(w6) > 1 AND right(w6, 1) = 'e' AND ({m('k7')} > 1 OR {m('k7')} = 1 AND NOT {cvc('c7', 'k7')}) THEN c7 ELSE w6 END"},
        {"c8": chop("w7", 1)},
        {"k8": mask("c8")},
        {"w8": f"CASE WHEN right(w7, 2) = 'll' AND {m('k8')} > 1 THEN c8 ELSE w7 END"},
        {"w9": f"CASE WHEN octet_length(encode(w)) BETWEEN 3 AND 500 THEN w8 ELSE w END"},
    ]


def add_stem(words: DataFrame, word: str, out: str) -> DataFrame:
    """``words`` with the stem of the column ``word``; null stays null. Meant for distinct words."""

    @F.pandas_udf("string")
    def stems(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(stem, na_action="ignore")

    return words.withColumn(out, stems(word))


def stem_sql(source: str, name: str = "stems") -> str:
    """CTEs for DuckDB that end in ``name(token, term)`` for the query ``source`` with a column ``token``."""
    out, at = [f"{name}_0 AS (SELECT DISTINCT token, token AS w FROM ({source}))"], f"{name}_0"
    for i, stage in enumerate(_stages(), 1):
        out.append(f"{name}_{i} AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in stage.items())} FROM {at})")
        at = f"{name}_{i}"
    return ",\n".join(out) + f",\n{name} AS (SELECT token, w9 AS term FROM {at})"
