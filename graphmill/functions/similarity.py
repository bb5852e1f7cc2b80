"""String similarities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from graphmill.functions.text import normalize_for_linking, split_words


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def levenshtein_similarity(a: str | Column, b: str | Column, most: int | None = None) -> Column:
    """1 - distance / longer length in bytes; 0 beyond ``most`` edits, 1 for two empty strings."""
    x, y = _col(a), _col(b)
    d, longer = F.levenshtein(x, y), F.greatest(F.octet_length(x), F.octet_length(y))
    close = F.when(longer == 0, F.lit(1.0)).otherwise(1 - d / longer)
    return close if most is None else F.when(d > most, F.lit(0.0)).otherwise(close)


def jaccard(a: str | Column, b: str | Column, empty: float = 1.0) -> Column:
    """Shared share of the distinct words; ``empty`` if both have none."""
    x, y = split_words(a), split_words(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(x, y)) / union)


def containment(a: str | Column, b: str | Column) -> Column:
    """Shared words over the distinct words of the side with fewer."""
    x, y = F.array_distinct(split_words(a)), F.array_distinct(split_words(b))
    least = F.least(F.size(x), F.size(y))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / least)


def text_similarity(a: str | Column, b: str | Column) -> Column:
    """0.4 Jaccard + 0.4 containment + 0.2 Levenshtein, on lower case."""
    x, y = F.lower(_col(a)), F.lower(_col(b))
    return 0.4 * jaccard(x, y, 0.0) + 0.4 * containment(x, y) + 0.2 * levenshtein_similarity(x, y)


def name_similarity(query: str | Column, name: str | Column) -> Column:
    """1 if equal, 0.8 if one holds the other, else Jaccard of words."""
    x, y = F.lower(_col(query)), F.lower(_col(name))
    return F.when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.8).otherwise(jaccard(x, y, 0.0))


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = bytearray(len(b))
    first = []
    for i, ch in enumerate(a):
        at = next((k for k in range(max(0, i - reach), min(len(b), i + reach + 1)) if not used[k] and b[k] == ch), -1)
        if at >= 0:
            used[at] = 1
            first.append(ch)
    if not first:
        return 0.0
    second = [c for c, u in zip(b, used) if u]
    swaps = sum(x != y for x, y in zip(first, second)) // 2
    m = len(first)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


@F.pandas_udf(DoubleType())
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _jaro(x, y) for x, y in zip(a, b)], dtype="float64")


def _winkler(a: str, b: str) -> float:
    j = _jaro(a, b)
    same = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return j + 0.1 * same * (1 - j)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro with a tenth of the rest for each of up to four common first letters."""
    return pd.Series([None if x is None or y is None else _winkler(x, y) for x, y in zip(a, b)], dtype="float64")


# The sound classes of English Soundex.
_CLASSES = {c: d for d, letters in {"1": "BFPV", "2": "CGJKQSXZ", "3": "DT", "4": "L", "5": "MN", "6": "R"}.items() for c in letters}


@F.pandas_udf(StringType())
def soundex_steady(name: pd.Series) -> pd.Series:
    """Soundex in which vowels do not end a run of one class, so that B-vowel-B is coded once."""

    def code(s: str | None) -> str | None:
        letters = [c for c in (s or "").upper() if c.isascii() and c.isalpha()]
        if not letters:
            return None if s is None else ""
        out, last = letters[0], _CLASSES.get(letters[0])
        for c in letters[1:]:
            digit = _CLASSES.get(c)
            if digit and digit != last:
                out += digit
                last = digit
        return (out + "000")[:4]

    return name.map(code)


def link_similarity(a: str | Column, b: str | Column, sound: bool = False) -> Column:
    """Best of cut Levenshtein, Jaro-Winkler, Jaccard and, if asked, Soundex (0.9) on normalised names; 1 if equal."""
    x, y = normalize_for_linking(a), normalize_for_linking(b)
    parts = [levenshtein_similarity(x, y, 2), jaro_winkler(x, y), jaccard(x, y)]
    if sound:
        parts.append(F.when(soundex_steady(x) == soundex_steady(y), 0.9).otherwise(0.0))
    return F.when(x == y, 1.0).otherwise(F.greatest(*parts))


def _edits(a: str, b: str, most: int) -> int:
    """Levenshtein distance; ``most`` + 1 if it is larger than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            row[j] = min(last[j - 1] + (x != b[j - 1]), last[j] + 1, row[j - 1] + 1)
        if min(row) > most:
            return most + 1
    return row[-1]


def alike(a: str, b: str, least: float) -> bool:
    """Whether ``link_similarity`` of two normalised names, without Soundex, is at least ``least``."""
    if a == b or _winkler(a, b) >= least:
        return True
    longer = max(len(a.encode()), len(b.encode()))
    for d in (1, 2):
        if 1 - d / longer >= least and _edits(a, b, d) == d:
            return True
    x, y = set(a.split()), set(b.split())
    return bool(x | y) and len(x & y) / len(x | y) >= least
