"""Measures of answers, order statistics, maps and weights."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from graphmill.functions.text import split_words


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def f1(generated: str | Column, truth: str | Column) -> Column:
    """Token F1; repeats count on the generated side."""
    g, t = split_words(F.lower(_col(generated))), split_words(F.lower(_col(truth)))
    hits = F.size(F.filter(g, lambda w: F.array_contains(t, w)))
    p, r = hits / F.size(g), hits / F.size(t)
    return F.when((F.size(g) == 0) | (F.size(t) == 0) | (hits == 0), F.lit(0.0)).otherwise(2 * p * r / (p + r))


def _bleu(g: list[str], t: list[str]) -> float:
    from collections import Counter
    from math import exp, log

    if not g or not t:
        return 0.0
    logs = 0.0
    for n in range(1, 5):
        a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (g, t))
        hit, all_ = sum(min(c, b[k]) for k, c in a.items()), sum(a.values())
        if not hit or not all_:
            return 0.0
        logs += log(hit / all_) / 4
    return exp(logs) * (1.0 if len(g) >= len(t) else exp(1 - len(t) / len(g)))


@F.pandas_udf(DoubleType())
def bleu4(generated: pd.Series, truth: pd.Series) -> pd.Series:
    """BLEU with n-grams up to 4 and brevity penalty; 0 if any precision is 0."""
    return pd.Series([_bleu((g or "").split(), (t or "").split()) for g, t in zip(generated, truth)], dtype="float64")


def _lcs(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


@F.pandas_udf(DoubleType())
def rouge_l(generated: pd.Series, truth: pd.Series) -> pd.Series:
    """F measure of the longest common word sequence, recall weighted by 1.2."""
    out = []
    for g, t in zip(generated, truth):
        a, b = (g or "").split(), (t or "").split()
        n = _lcs(a, b) if a and b else 0
        if not n:
            out.append(0.0)
            continue
        p, r, w = n / len(a), n / len(b), 1.2**2
        out.append((1 + w) * p * r / (r + w * p))
    return pd.Series(out, dtype="float64")


def floor_percentile(values: str | Column, share: float) -> Column:
    """The element at floor(n * share) of the sorted values of an array, without interpolation."""
    v = F.array_sort(_col(values))
    return F.try_element_at(v, F.least(F.floor(F.size(v) * share), F.size(v) - 1).cast("int") + 1)


def map_hash(properties: str | Column) -> Column:
    """SHA-256 of a property map, whatever the order of its keys."""
    return F.sha2(F.to_json(F.array_sort(F.map_entries(_col(properties)))), 256)


def map_changes(before: str | Column, after: str | Column) -> Column:
    """Struct of the keys added, removed and changed between two maps; null maps count as empty."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    b, a = F.coalesce(_col(before), empty), F.coalesce(_col(after), empty)
    kb, ka = F.map_keys(b), F.map_keys(a)
    changed = F.filter(F.array_intersect(ka, kb), lambda k: ~F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k)))
    return F.struct(F.array_sort(F.array_except(ka, kb)).alias("added"), F.array_sort(F.array_except(kb, ka)).alias("removed"), F.array_sort(changed).alias("changed"))


def completeness(fields: list[Column]) -> Column:
    """Share of the fields that are filled."""
    return sum((F.when(f.isNotNull(), 1.0).otherwise(0.0) for f in fields), F.lit(0.0)) / len(fields)


# Default strengths of temporal relation types (0.3 for any other); the first three are causal.
TEMPORAL_STRENGTH = {"Caused": 0.9, "Enabled": 0.6, "Prevented": 0.7, "Correlated": 0.5}
CAUSAL_TYPES = ("Caused", "Enabled", "Prevented")
CAUSAL_WORDS = r"(?i)caused|led_to|resulted_in|enabled|triggered"


def is_causal(temporal_type: str | Column, strength: str | Column, relation: str | Column, least: float = 0.0) -> Column:
    """Causal by temporal type, if the strength (where given) reaches ``least``, or by the relation's name."""
    typed = _col(temporal_type).isin(*CAUSAL_TYPES) & (F.coalesce(_col(strength), F.lit(1.0)) >= least)
    return F.coalesce(typed, F.lit(False)) | F.coalesce(_col(relation).rlike(CAUSAL_WORDS), F.lit(False))


def temporal_relevance(start: str | Column, end: str | Column, now: str | Column) -> Column:
    """Boost of an interval (Unix seconds) by the whole years between its middle and ``now``: 0.3 up to
    ten years, falling to 0 at fifty, from 0.1 to 0 at two hundred, 0.05 beyond."""
    middle = F.floor((_col(start) + _col(end)) / 2)
    years = F.floor(F.abs(_col(now) - middle) / (365 * 24 * 3600))
    return F.when(years <= 10, 0.3).when(years <= 50, 0.3 * (1 - (years - 10) / 40)).when(years <= 200, 0.1 * (1 - (years - 50) / 150)).otherwise(0.05)


def default_strength(temporal_type: str | Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TEMPORAL_STRENGTH.items() for x in kv])
    return F.coalesce(F.try_element_at(table, _col(temporal_type)), F.lit(0.3))


def dynamic_weight(confidence: str | Column, similarity: Column | None = None, temporal: Column | None = None, matches: Column | None = None, strength: Column | None = None) -> Column:
    """confidence * (1 + similarity + temporal + 0.15 * matching concepts + 0.2 * causal strength)."""
    zero = F.lit(0.0)
    extra = F.coalesce(similarity if similarity is not None else zero, zero) + F.coalesce(temporal if temporal is not None else zero, zero)
    extra = extra + 0.15 * F.coalesce(matches if matches is not None else zero, zero) + 0.2 * F.coalesce(strength if strength is not None else zero, zero)
    return _col(confidence) * (1 + extra)


def contains(start: str | Column, end: str | Column, at: str | Column) -> Column:
    return _col(at).between(_col(start), _col(end))


def overlaps(start: str | Column, end: str | Column, low: str | Column, high: str | Column) -> Column:
    """Whether two closed intervals have a point in common."""
    return (_col(start) <= _col(high)) & (_col(end) >= _col(low))
