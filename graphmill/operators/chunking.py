"""Chunkers, document structure, summaries.

Chunkers whose cuts do not depend on each other are column expressions.  Those
that walk a text run inside its row, in Arrow batches, without a shuffle.
Offsets are characters, end exclusive.  Null texts give no chunks.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphmill.functions.text import sentences, split_words

CHUNK = "seq int, start_offset bigint, end_offset bigint, content string"


def per_row(df: DataFrame, id_col: str, text_col: str, make: Callable[[str], list[tuple]], fields: str) -> DataFrame:
    """``(id, …fields)``: the rows that ``make`` gives for each text, in Arrow batches."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {fields}"
    names = [f.strip().split(" ")[0] for f in re.split(r",(?![^<]*>)", fields)]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    types = [arrow.field(n).type for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                row, out = [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    made = make(t) if t is not None else []
                    row += [i] * len(made)
                    out += made
                cols = list(zip(*out)) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), *(pa.array(list(c), t) for c, t in zip(cols, types))], [id_col, *names])

    return df.select(id_col, text_col).mapInArrow(run, schema)


# ---------------------------------------------------------------- by expression


def fixed_chunks(df: DataFrame, id_col: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """Windows of ``size`` characters that begin every ``size - overlap`` ones."""
    step = size - overlap
    rows = df.select(id_col, F.col(text_col).alias("t")).where(F.length("t") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.length("t"), F.lit(step))).alias("s")
    return rows.select(id_col, "t", starts).select(id_col, ((F.col("s") - 1) / step).cast("int").alias("seq"), (F.col("s") - 1).cast("bigint").alias("start_offset"), F.least(F.col("s") - 1 + size, F.length("t")).cast("bigint").alias("end_offset"), F.col("t").substr(F.col("s"), F.lit(size)).alias("content"))


def paragraph_chunks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Trimmed pieces between blank lines, without empty ones."""
    parts = F.filter(F.transform(F.split(F.col(text_col), "\n\n"), lambda p: F.regexp_replace(p, r"^[ \t\n\r]+|[ \t\n\r]+\z", "")), lambda p: p != "")
    return df.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(parts).alias("seq", "content"))


# ---------------------------------------------------------------- walking a text


def _before_space(text: str, low: int, high: int) -> int:
    at = text.rfind(" ", low, high)
    return at if at >= 0 else -1


def window_cuts(text: str, size: int, overlap: int) -> list[tuple]:
    """Windows ended at the last sentence end of their last 200 characters, or the last blank of their last 50."""
    out, start, n = [], 0, len(text)
    while start < n:
        end = min(start + size, n)
        if end < n:
            ends = [m.end() for m in re.finditer(r"[.!?](?=\s|$)", text[max(start, end - 200) : end])]
            if ends:
                end = max(start, end - 200) + ends[-1]
            else:
                space = _before_space(text, max(start, end - 50), end)
                end = space if space > start else end
        if text[start:end].strip():
            out.append((len(out), start, end, text[start:end]))
        if end >= n:
            break
        start = max(start + 1, end - overlap)
    return out


# Separators from the strongest to the weakest.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ": ", " ")


def hierarchical_cuts(text: str, size: int, overlap: int, least: int = 50) -> list[tuple]:
    """Windows ended after the last strongest separator beyond their first quarter; starts fall back to a word's begin.

    All places where a separator ends are listed once, by separator, and so are
    the begins of words; each window looks its places up in the sorted lists.
    """
    places = [(len(mark), [m.start() + len(mark) for m in re.finditer(f"(?={re.escape(mark)})", text)]) for mark in SEPARATORS]
    begins = [m.end() for m in re.finditer(r"[ \n\t]", text)]

    def last(sorted_places: list[int], low: int, high: int) -> int | None:
        """The greatest place in (low, high]."""
        k = bisect_right(sorted_places, high)
        return sorted_places[k - 1] if k and sorted_places[k - 1] > low else None

    spans, at = [], 0
    while at < len(text):
        full = min(at + size, len(text))
        cut = full
        if full < len(text):
            ends = (last(p, max(at + (full - at) // 4, at + n - 1), full) for n, p in places)
            cut = next((e for e in ends if e is not None), full)
        spans.append((at, cut))
        if cut == len(text):
            break
        back = cut - overlap
        at = last(begins, at + 1, back) or max(back, at + 1)
    kept = [(a, b) for a, b in spans if len(text[a:b].strip()) >= least]
    return [(i, a, b, text[a:b]) for i, (a, b) in enumerate(kept)]


_SENTENCE = re.compile(r"[^.!?]+[.!?]*\s*")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _SENTENCE.finditer(text) if m.group().strip()]


def _joined(text: str, spans: list[tuple[int, int]], cuts: list[int]) -> list[tuple]:
    """Chunks of whole sentences; ``cuts`` are the sentence numbers at which a chunk begins."""
    edges = [*cuts, len(spans)]
    return [(i, spans[a][0], spans[b - 1][1], text[spans[a][0] : spans[b - 1][1]]) for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]


def _vector(sentence: str) -> Counter:
    return Counter(w.lower() for w in re.findall(r"\w+", sentence))


def _cosine(a: Counter, b: Counter) -> float:
    if not a or not b:
        return 0.0
    size = (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
    return sum(v * b[k] for k, v in a.items()) / size


def semantic_cuts(text: str, percentile: float = 0.95, most: int = 50) -> list[tuple]:
    """Sentences joined, broken where the distance of neighbours exceeds the text's own percentile (floor index)."""
    spans = sentence_spans(text)
    if not spans:
        return []
    vectors = [_vector(text[a:b]) for a, b in spans]
    apart = [1 - _cosine(x, y) for x, y in zip(vectors, vectors[1:])]
    limit = sorted(apart)[min(int(len(apart) * percentile), len(apart) - 1)] if apart else 1.0
    cuts = [0]
    for i, d in enumerate(apart, 1):
        if d > limit or i - cuts[-1] >= most:
            cuts.append(i)
    return _joined(text, spans, cuts)


def similarity_cuts(text: str, least: float, most: int) -> list[tuple]:
    """Sentences joined while the next one shares at least ``least`` (Jaccard) with the chunk so far."""
    spans, cuts, have = sentence_spans(text), [0], set()
    for i, (a, b) in enumerate(spans):
        words = set(re.findall(r"\w+", text[a:b].lower()))
        union = have | words
        if i > cuts[-1] and (i - cuts[-1] >= most or (len(have & words) / len(union) if union else 0) < least):
            cuts.append(i)
            have = set()
        have |= words
    return _joined(text, spans, cuts) if spans else []


def window_chunks(df: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    return per_row(df, id_col, text_col, lambda t: window_cuts(t, size, overlap), CHUNK)


def hierarchical_chunks(df: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    return per_row(df, id_col, text_col, lambda t: hierarchical_cuts(t, size, overlap), CHUNK)


def sentence_chunks(df: DataFrame, id_col: str, text_col: str, sentences: int = 5) -> DataFrame:
    def make(t: str) -> list[tuple]:
        spans = sentence_spans(t)
        return _joined(t, spans, list(range(0, len(spans), sentences)))

    return per_row(df, id_col, text_col, make, CHUNK)


def semantic_chunks(df: DataFrame, id_col: str, text_col: str, percentile: float = 0.95) -> DataFrame:
    return per_row(df, id_col, text_col, lambda t: semantic_cuts(t, percentile), CHUNK)


def similarity_chunks(df: DataFrame, id_col: str, text_col: str, least: float = 0.1, most: int = 5) -> DataFrame:
    return per_row(df, id_col, text_col, lambda t: similarity_cuts(t, least, most), CHUNK)


#: Chunkers by name; a user may add ``name: function(text) -> [(seq, start, end, content)]``.
STRATEGIES: dict[str, Callable[[str], list[tuple]]] = {
    "window": lambda t: window_cuts(t, 1000, 200),
    "hierarchical": lambda t: hierarchical_cuts(t, 1000, 200),
    "semantic": semantic_cuts,
    "similarity": lambda t: similarity_cuts(t, 0.1, 5),
    "sized": lambda t: sized_cuts(t),
    "topic": lambda t: topic_cuts(t),
    "hybrid": lambda t: hybrid_cuts(t),
    "late": lambda t: late_sections(t, 32_768),
    "coherent": lambda t: coherent_cuts(t),
}


def chunk_with(df: DataFrame, strategy: str, id_col: str, text_col: str) -> DataFrame:
    return per_row(df, id_col, text_col, STRATEGIES[strategy], CHUNK)


# Words whose full stop does not end a sentence.
ABBREVIATIONS = "Dr Mr Mrs Ms Prof Jr Sr Inc Corp Ltd Co etc vs e.g i.e cf pp".split()
_SHORT = "|".join(re.escape(a) for a in ABBREVIATIONS)
#: Ends of sentences: a mark before a blank, a line end or the text's end, not after an abbreviation or the initial a text begins with.
SENTENCE_END = rf"(?<!^[A-Z](?=\.))(?<!(?:^|[ \t\r\n\f])(?i:{_SHORT})(?=\.))[.!?](?=[ \n]|\z)"


def sentence_ends(text: str | Column) -> Column:
    """How many sentences a text ends, by ``SENTENCE_END``."""
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(SENTENCE_END))


def end_before(text: str, start: int, end: int, window: int = 300) -> int | None:
    """The last sentence end in the last ``window`` characters of ``text[start:end]``."""
    low = max(start, end - window)
    part, last = text[low:end], None
    for m in re.finditer(r"[.!?](?=[ \n]|\Z)", part):
        word = re.split(r"[ \t\r\n\f]", part[: m.start()])[-1]
        initial = m.start() == 1 and part[0].isascii() and part[0].isupper()
        if m.group() == "." and (word.lower() in {a.lower() for a in ABBREVIATIONS} or initial):
            continue
        last = low + m.end()
    return last


def sized_cuts(text: str, least: int = 200, most: int = 2000) -> list[tuple]:
    """Paragraphs of at least ``least`` characters: shorter ones go with the one before, longer ones than ``most`` are cut at sentence ends.

    A single sentence longer than ``most`` stays whole.
    """
    edges, at = [], 0
    for m in re.finditer(r"\n\s*\n", text):
        edges.append((at, m.start()))
        at = m.end()
    spans: list[list[int]] = []
    for a, b in [(a, b) for a, b in [*edges, (at, len(text))] if text[a:b].strip()]:
        if b - a > most:
            pieces = [(a + x, a + y) for x, y in sentence_spans(text[a:b])]
            for x, y in pieces:
                if spans and spans[-1][0] >= a and y - spans[-1][0] <= most:
                    spans[-1][1] = y
                else:
                    spans.append([x, y])
        elif b - a < least and spans:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    return [(i, a, b, text[a:b]) for i, (a, b) in enumerate(spans)]


def topic_cuts(text: str, least: float = 0.1) -> list[tuple]:
    """Paragraphs joined while the next one shares at least ``least`` of their words (Jaccard)."""
    spans, out = [m.span() for m in re.finditer(r"(?s)\S.*?(?=\n\s*\n|\Z)", text)], []
    have: set[str] = set()
    for a, b in spans:
        words = set(re.findall(r"\w+", text[a:b].lower()))
        union = have | words
        if out and union and len(have & words) / len(union) >= least:
            out[-1][1] = b
            have |= words
        else:
            out.append([a, b])
            have = words
    return [(i, a, b, text[a:b]) for i, (a, b) in enumerate(out)]


def hybrid_cuts(text: str, size: int = 1000, least: float = 0.1) -> list[tuple]:
    """Topics, those longer than ``size`` cut into sentences joined by similarity."""
    out = []
    for _, a, b, part in topic_cuts(text, least):
        out += [(a + x, a + y) for _, x, y, _ in similarity_cuts(part, least, 5)] if b - a > size else [(a, b)]
    return [(i, a, b, text[a:b]) for i, (a, b) in enumerate(out)]


def late_sections(text: str, most: int) -> list[tuple]:
    """Runs of whole paragraphs of at most ``most`` characters, for a model that reads a section at once; one longer paragraph stays whole."""
    if len(text) <= most:
        return [(0, 0, len(text), text)] if text.strip() else []
    out, at = [], 0
    for part in text.split("\n\n"):
        end = at + len(part)
        if out and end - out[-1][0] <= most:
            out[-1][1] = end
        else:
            out.append([at, end])
        at = end + 2
    return [(i, a, b, text[a:b]) for i, (a, b) in enumerate((a, b) for a, b in out if text[a:b].strip())]


class Coherence:
    """Coherence of runs of sentences: ``weight`` * mean likeness of neighbours + the rest * mean likeness within a window.

    Sums are kept from the beginning, for each distance within the window, so a
    run is scored without walking it.  A single sentence has coherence 1.
    """

    def __init__(self, vectors: list, weight: float = 0.7, window: int = 3, like: Callable | None = None) -> None:
        self.weight, like = weight, like or _cosine
        self.sums = []
        for d in range(1, max(1, window // 2) + 1):
            run = [0.0]
            for x, y in zip(vectors, vectors[d:]):
                run.append(run[-1] + like(x, y))
            self.sums.append(run)

    def __call__(self, a: int, b: int) -> float:
        if b - a < 2:
            return 1.0
        parts = [(run[b - d] - run[a], b - a - d) for d, run in enumerate(self.sums, 1) if b - a > d]
        near = parts[0][0] / parts[0][1]
        wide = sum(s for s, _ in parts) / sum(n for _, n in parts)
        return min(1.0, max(0.0, self.weight * near + (1 - self.weight) * wide))


def coherent_cuts(text: str, least_sentences: int = 2, most_sentences: int = 20, rounds: int = 100) -> list[tuple]:
    """Cuts that raise the mean coherence of the pieces most, one after another, while it rises and at most ``rounds`` times.

    Pieces keep ``least_sentences``; those with more than ``most_sentences`` are
    first cut at their best place, whether it rises or not.
    """
    spans = sentence_spans(text)
    if not spans:
        return []
    score = Coherence([_vector(text[a:b]) for a, b in spans])

    def best(a: int, b: int) -> tuple:
        """``(gain of the sum, minus the place)``; the first of equal places."""
        return max(((score(a, c) + score(c, b) - score(a, b), -c) for c in range(a + least_sentences, b - least_sentences + 1)), default=(None, 0))

    done, long = [], [(0, len(spans))]
    while long:
        a, b = long.pop()
        gain, cut = best(a, b) if b - a > most_sentences else (None, 0)
        if gain is None:
            done.append((a, b))
        else:
            long += [(a, -cut), (-cut, b)]
    total, pieces = sum(score(a, b) for a, b in done), {p: best(*p) for p in done}
    heap = [(-g, p[0], p, -c) for p, (g, c) in pieces.items() if g is not None]
    heapq.heapify(heap)
    for _ in range(rounds):
        if not heap:
            break
        gain, _, (a, b), cut = heap[0]
        n = len(pieces)
        if (total - gain) / (n + 1) - total / n <= 1e-12:
            break
        heapq.heappop(heap)
        total -= gain
        del pieces[a, b]
        for p in ((a, cut), (cut, b)):
            g, c = pieces[p] = best(*p)
            if g is not None:
                heapq.heappush(heap, (-g, p[0], p, -c))
    return _joined(text, spans, sorted(a for a, _ in pieces))


def sentence_coherence(text: str | Column) -> Column:
    """Mean share of common words (Jaccard) of neighbouring sentences; 1 for fewer than two."""
    each = F.transform(sentences(text), lambda s: F.array_distinct(split_words(F.lower(s))))
    n = F.size(each)
    pair = F.zip_with(F.slice(each, 1, F.greatest(n - 1, F.lit(0))), F.slice(each, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.when(F.size(F.array_union(a, b)) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))))
    return F.when(n < 2, 1.0).otherwise(F.aggregate(pair, F.lit(0.0), lambda s, x: s + x) / (n - 1))


def contexts(df: DataFrame, id_col: str, text_col: str, before: str, target: str, after: str) -> DataFrame:
    """``(id, word, place)``: middle words of three in a row that hold ``before``, ``target`` and ``after``, without case."""
    w = split_words(text_col)
    low = F.transform("w", F.lower)
    ok = lambda i, part: F.contains(F.element_at("low", i), F.lit(part.lower()))
    hits = F.filter(F.sequence(F.lit(2), F.size("w") - 1), lambda i: ok(i - 1, before) & ok(i, target) & ok(i + 1, after))
    rows = df.select(id_col, w.alias("w")).where(F.size("w") > 2).withColumn("low", low)
    return rows.select(id_col, "w", F.explode(hits).alias("i")).select(id_col, F.element_at("w", F.col("i")).alias("word"), (F.col("i") - 1).alias("place"))


# ---------------------------------------------------------------- structure


def boundary_marks(text: str) -> list[tuple]:
    """Places where sentence, paragraph, heading, list and code begin or end; the first kind of a place wins."""
    found: dict[int, tuple[str, float]] = {}
    for kind, pattern, sure in (
        ("Heading", r"(?m)^#{1,6}\s.+$", 0.95),
        ("CodeBlock", r"(?m)^```.*$", 0.95),
        ("List", r"(?m)^\s*(?:[-*+]|\d+[.)])\s", 0.8),
        ("Paragraph", r"\n\s*\n", 0.9),
        ("Sentence", r"[.!?](?=\s+|$)", 0.7),
    ):
        for m in re.finditer(pattern, text):
            at = m.end() if kind in ("Paragraph", "Sentence") else m.start()
            if kind == "Sentence" and at < 10:
                continue
            found.setdefault(at, (kind, sure))
    return [(at, *found[at]) for at in sorted(found)]


def boundaries(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return per_row(df, id_col, text_col, boundary_marks, "position bigint, kind string, confidence double")


_HEADING = re.compile(r"(?m)^(#{1,6})[ \t]+(.+?)[ \t]*$")


def section_rows(text: str) -> list[tuple]:
    """``(n, parent, level, title, path, start, end)``: from each heading to the next one of the same or a higher level."""
    heads = [(m.start(), m.end(), len(m.group(1)), m.group(2)) for m in _HEADING.finditer(text)]
    rows, stack = [], []
    for i, (start, body, level, title) in enumerate(heads):
        while stack and stack[-1][1] >= level:
            stack.pop()
        end = next((s for s, _, lv, _ in heads[i + 1 :] if lv <= level), len(text))
        rows.append((i, stack[-1][0] if stack else None, level, title, [t for _, _, t in stack] + [title], start, body, end))
        stack.append((i, level, title))
    return rows


def sections(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Section tree of markdown texts; repeated rows of one id and text count once."""
    rows = df.select(id_col, text_col).where(F.col(text_col).isNotNull()).dropDuplicates([id_col])
    return per_row(rows, id_col, text_col, section_rows, "n int, parent int, level int, title string, path array<string>, start_offset bigint, body_offset bigint, end_offset bigint")


def enriched(chunks: DataFrame, parts: DataFrame) -> DataFrame:
    """Chunks with the deepest section they begin in (chapter, section, path) and their place in the document, 0 to 1."""
    key = chunks.columns[0]
    c = chunks.dropDuplicates([key, "seq"])
    s = parts.select(key, F.col("start_offset").alias("s0"), F.col("end_offset").alias("s1"), "level", "title", "path")
    inside = c.join(s, (c[key] == s[key]) & (c["start_offset"] >= s["s0"]) & (c["start_offset"] < s["s1"]), "left").drop(s[key])
    g = inside.groupBy(key, "seq").agg(F.max_by("path", F.struct("level", "s0")).alias("heading_path"), F.max("level").alias("structural_level"))
    last = F.max("seq").over(W.partitionBy(key))
    full = c.withColumn("position", F.when(last > 0, F.col("seq") / last).otherwise(0.0))
    return full.join(g, [key, "seq"]).select("*", F.try_element_at("heading_path", F.lit(1)).alias("chapter"), F.try_element_at("heading_path", F.lit(2)).alias("section"))


# ---------------------------------------------------------------- summaries


def summarize(text: str, most: int) -> str:
    """Sentences of the highest scores that fit into ``most`` characters, in text order.

    Score: 0.3 place (first best) + 0.2 length + 0.3 frequency of words + 0.1 names + 0.1 numbers.
    """
    spans = sentence_spans(text)
    if not spans:
        return text[:most]
    words = [re.findall(r"\w+", text[a:b]) for a, b in spans]
    counts = Counter(w.lower() for ws in words for w in ws if len(w) > 3)
    top = max(counts.values(), default=1)
    scored = []
    for i, ((a, b), ws) in enumerate(zip(spans, words)):
        freq = sum(counts[w.lower()] for w in ws) / (len(ws) * top) if ws else 0.0
        names = sum(w[:1].isupper() for w in ws[1:]) / len(ws) if ws else 0.0
        numbers = any(w.isdigit() for w in ws)
        score = 0.3 * (1 - i / len(spans)) + 0.2 * min(len(ws) / 20, 1.0) + 0.3 * freq + 0.1 * min(names, 1.0) + 0.1 * numbers
        scored.append((-score, i, text[a:b].strip()))
    taken, used = [], 0
    for _, i, s in sorted(scored):
        if used + len(s) + 1 <= most:
            taken.append((i, s))
            used += len(s) + 1
    return " ".join(s for _, s in sorted(taken)) or text[:most]


def extractive_summaries(df: DataFrame, id_col: str, text_col: str, most: int = 300) -> DataFrame:
    return per_row(df, id_col, text_col, lambda t: [(summarize(t, most),)], "summary string")


def summary_tree(chunks: DataFrame, fan: int = 5, most: int = 300, max_levels: int = 12) -> DataFrame:
    """``(id, level, node, parent, summary)``: each level summarises ``fan`` nodes of the one below, up to a root.

    All documents go up together, one aggregation a level; no more levels are
    built than the longest document needs.
    """
    key = chunks.columns[0]

    @F.pandas_udf("string")
    def short(text):
        import pandas as pd

        return pd.Series([summarize(t or "", most) for t in text])

    level = chunks.dropDuplicates([key, "seq"]).select(key, F.lit(0).alias("level"), F.col("seq").alias("node"), short("content").alias("summary"))
    longest = chunks.agg(F.max("seq")).first()[0]
    out, width = None, (longest or 0) + 1
    for n in range(max_levels):
        last = width <= 1
        done = level.withColumn("parent", F.lit(None).cast("int") if last else F.floor(F.col("node") / fan).cast("int"))
        out = done if out is None else out.unionByName(done)
        if last:
            break
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "summary"))), lambda x: x["summary"]), " ")  # at most ``fan`` of them
        level = level.groupBy(key, F.floor(F.col("node") / fan).cast("int").alias("up")).agg(text.alias("t")).select(key, F.lit(n + 1).alias("level"), F.col("up").alias("node"), short("t").alias("summary"))
        width = -(-width // fan)
    return out.select(key, "level", "node", "parent", "summary")


def tree_search(tree: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Nodes by keyword hits + 2 * share of query words + 0.5 / (level + 1); above 0.1."""
    words = [w for w in query.lower().split() if w]
    low = F.lower("summary")
    hits = sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
    score = F.when(hits > 0, hits + 2.0 * hits / max(len(words), 1) + 0.5 / (F.col("level") + 1)).otherwise(0.0)
    return tree.withColumn("score", score).where("score > 0.1").orderBy(F.desc("score"), tree.columns[0], "level", "node").limit(k)
