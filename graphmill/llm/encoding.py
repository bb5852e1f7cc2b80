"""Text read in a wrong character encoding: found and restored by a table of garbled forms.

The words of the corpus that hold characters beyond ASCII are collected with
the number of different texts they occur in.  Each clean word is written and read again
through every chain of encodings; the garbled forms make a table that is
hash-joined with the words of the texts.  A hit counts if the form is rarer
than the word it comes from, as a real word would not be; a longer form of
letters also if it is as rare.  No word that could count is left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.session import materialize

# Names of the 8-bit encodings that texts of these scripts are commonly read in.
LATIN = ("cp1252", "latin-1", "cp1250", "iso8859-2", "iso8859-15", "cp1254", "cp437", "cp850", "cp852", "mac_roman", "mac_latin2", "cp1257")
CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic")
# Encodings of wide scripts with two bytes a character, and those they are then read in.
WIDE_WRITTEN = ("shift_jis", "euc_jp", "gbk", "big5", "euc_kr")
WIDE_READ = ("cp1252", "latin-1", "mac_roman", "cp437", "cp1251")
#: Encodings through which UTF-8 of runs and wide characters is also read twice, and the first two three times.
#: Single letters of alphabets go through all pairs; what a run becomes is made of what its letters become.
OFTEN = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "mac_roman")

LOST = "�"
WIDE = "⺀-ヿ㐀-鿿가-힯豈-﫿＀-￯"
_TOKEN = re.compile(r"(?<![A-Za-z])[A-Za-z]*+[^\x00-\x7f]+(?:[A-Za-z]++[^\x00-\x7f]+)*+[A-Za-z]*+")
_UNIT = re.compile(rf"[{WIDE}]|[^\x00-\x7f{WIDE}]+")
_WIDE = re.compile(rf"[{WIDE}]")
_WIDE_RUN = re.compile(rf"[{WIDE}]{{2,}}")
#: Least copies of a word that is more frequent than some form of it, as a form met has one at least; least length
#: of words swapped between 8-bit encodings; the longest form of one character read twice (three bytes, each three).
LEAST_COPIES, LEAST_LETTERS, LONGEST_CHARACTER = 2, 3, 9


@cache
def reading(encoding: str) -> list[str]:
    """The character of each byte; bytes that the encoding lacks are read as control characters."""
    return [bytes([b]).decode(encoding, "replace").replace(LOST, chr(b)) for b in range(256)]


def read_as(data: bytes, encoding: str) -> str:
    table = reading(encoding)
    return "".join([table[b] for b in data])


def chains(twice_in: tuple[str, ...] = OFTEN) -> list[tuple[str, ...]]:
    """UTF-8 read as each encoding, once, twice or three times; named by the encodings read in."""
    once = [(a,) for a in (*LATIN, *CYRILLIC)]
    twice = [(a, b) for a in twice_in for b in twice_in]
    return once + twice + [(a, a, a) for a in OFTEN[:2]]


def garble(word: str, chain: tuple[str, ...]) -> str:
    for encoding in chain:
        word = read_as(word.encode("utf-8"), encoding)
    return word


@cache
def swaps(letter: str) -> tuple[tuple[str, str], ...]:
    """The pairs (written in, read in) of 8-bit encodings that change this character."""
    out = []
    for written in (*LATIN, *CYRILLIC):
        try:
            data = letter.encode(written)
        except UnicodeEncodeError:
            continue
        out += [(written, r) for r in (*LATIN, *CYRILLIC) if reading(r)[data[0]] != letter]
    return tuple(out)


def swapped(word: str) -> dict[str, str]:
    """Forms of a whole word written in one 8-bit encoding and read in another, or as UTF-8 with losses."""
    out: dict[str, str] = {}
    done: dict[str, bytes | None] = {}
    for written, read in dict.fromkeys(pair for c in dict.fromkeys(word) if ord(c) > 127 for pair in swaps(c)):
        if written not in done:
            try:
                done[written] = word.encode(written)
            except UnicodeEncodeError:
                done[written] = None
        if done[written] is not None:
            out.setdefault(read_as(done[written], read), f"{written}>{read}")
    for data in done.values():
        if data is not None and LOST in (form := data.decode("utf-8", "replace")):
            out.setdefault(form, "lost")
    out.pop(word, None)
    return out


def wide_forms(pair: str) -> list[tuple[str, str]]:
    """Two neighbouring characters of a wide script, written with two bytes each and read byte by byte.

    Two of them make four characters that no real word has; one makes two, which may be a quote and a letter.
    """
    out = []
    for written in WIDE_WRITTEN:
        try:
            data = pair.encode(written)
        except UnicodeEncodeError:
            continue
        if len(data) == 4 and min(data) > 127:
            out += [(read_as(data, read), f"{written}>{read}") for read in WIDE_READ]
    return out


def units(text: str) -> tuple[set[str], set[str], set[str]]:
    """Runs of characters beyond ASCII (of wide scripts: characters), whole words with such characters, and pairs of wide characters."""
    words = set(_TOKEN.findall(text))
    runs = [r for w in words for r in _WIDE_RUN.findall(w)]
    pairs = {r[i : i + 2] for r in runs for i in range(len(r) - 1)}
    return {u for w in words for u in _UNIT.findall(w)}, {w for w in words if len(w) >= LEAST_LETTERS and not _WIDE.search(w)}, pairs


def _units_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            ids, kinds, names = [], [], []
            for row, text in enumerate(part.column(1).to_pylist()):
                for kind, found in enumerate(units(text)):
                    ids += [row] * len(found)
                    kinds += [kind] * len(found)
                    names += found
            take = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(2).take(take), pa.array(kinds, pa.int8()), pa.array(names, pa.string())], ["id", "h", "kind", "unit"])


def _forms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    often, every = chains(), chains((*LATIN, *CYRILLIC))
    for batch in batches:
        out: list[tuple] = []
        for kind, unit, texts in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                for chain in every if len(unit) == 1 and not _WIDE.match(unit) else often:
                    form = garble(unit, chain)
                    # A single letter read as Cyrillic is two letters that may begin a real word.
                    if form != unit and (len(unit) > 1 or chain[-1] not in CYRILLIC or len(form) > 2):
                        out.append((0, form, unit, ">".join(("utf-8", *chain)), texts))
                out.append((0, LOST, unit, "lost", texts))
            elif kind == 2:
                out += [(0, form, unit, chain, texts) for form, chain in wide_forms(unit)]
            elif LOST not in unit:
                out += [(1, form, unit, chain, texts) for form, chain in swapped(unit).items()]
        cols = list(zip(*out)) or [(), (), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int8()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int64())], ["kind", "form", "word", "chain", "texts"])


def _pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A unit, and of a run every part that may be the form of one character or a short word."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            row, piece = [], []
            for i, (kind, unit) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                found = {unit}
                if kind == 0:
                    found |= {unit[s : s + n] for n in range(2, LONGEST_CHARACTER + 1) for s in range(len(unit) - n + 1)}
                    if LOST in unit:
                        found.add(LOST)
                row += [i] * len(found)
                piece += found
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in part.columns), pa.array(piece, pa.string())], ["kind", "unit", "n", "form"])


class Garbled:
    """The garbled units of a corpus, and what follows from them."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Null and ASCII texts are never garbled; an id that occurs more than once is judged on all its texts."""
        self.docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where((F.octet_length("text") > F.char_length("text")) & F.col("id").isNotNull())
        kind = df.schema[id_col].dataType.simpleString()
        self.occurs = materialize(self.docs.withColumn("h", F.xxhash64("text")).mapInArrow(_units_of, f"id {kind}, h bigint, kind tinyint, unit string"), "units")
        # Of two units the one in more different texts is more frequent, and only then the one in more copies: n holds both numbers.
        each = self.occurs.groupBy("kind", "unit", "h").agg(F.count(F.lit(1)).alias("copies"))
        counted = each.groupBy("kind", "unit").agg(F.count(F.lit(1)).alias("different"), F.sum("copies").alias("copies"))
        vocabulary = materialize(counted.select("kind", "unit", (F.shiftleft("different", 32) + F.col("copies")).alias("n"), "copies"), "vocabulary")
        clean = vocabulary.where(F.col("copies") >= LEAST_COPIES).drop("copies")
        letters = vocabulary.where("kind = 0").select("kind", F.explode(F.array_distinct(F.split("unit", ""))).alias("unit"), "n").where("unit != ''")
        words = clean.unionByName(letters).groupBy("kind", "unit").agg(F.max("n").alias("n"))
        # One word has hundreds of forms: the few words are spread over all tasks, and nothing made of them is broadcast.
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        forms = words.repartition(tasks, "unit").mapInArrow(_forms_of, "kind tinyint, form string, word string, chain string, texts bigint")
        # Of several words with the same form the most frequent one is meant.
        self.table = forms.groupBy("kind", "form").agg(F.max_by(F.struct("word", "chain", "texts"), F.struct("texts", "word", "chain")).alias("was"), F.count_distinct("word").alias("ways"))
        pieces = vocabulary.where("kind < 2").drop("copies").repartition(tasks, "unit").mapInArrow(_pieces_of, "kind tinyint, unit string, n bigint, form string")
        # Read as UTF-8 wrongly a word grows, so a longer form as frequent as its word is the form of it, not the reverse.
        further = (F.col("was.texts") > F.col("n")) | (F.col("kind") == 0) & (F.col("was.texts") == F.col("n")) & (F.length("form") > F.length("was.word"))
        self.hits = materialize(pieces.hint("merge").join(self.table, ["kind", "form"]).where(further).select("kind", "unit", "form", "was.word", "was.chain", "ways"), "hits")

    def found(self) -> DataFrame:
        """``(id)`` of every text that holds a garbled unit, each once."""
        return self.occurs.join(self.hits.select("kind", "unit").distinct(), ["kind", "unit"], "left_semi").select("id").distinct()

    def restored(self) -> DataFrame:
        """``(id, text)`` of the garbled texts, with each garbled unit replaced by its original where that is certain.

        A run is replaced if it can be read from left to right as forms in the
        table, a word if it is the form of one word only.  What was lost in
        reading, or has no certain original, stays.
        """
        sure = self.hits.where((F.col("kind") == 0) & (F.col("chain") != "lost") | (F.col("kind") == 1) & (F.col("ways") == 1))
        each = self.occurs.join(sure, ["kind", "unit"]).groupBy("id").agg(F.collect_set(F.struct("kind", "unit", "form", "word", "chain")).alias("known"))
        wrong = self.docs.join(self.found(), "id", "left_semi").join(each, "id", "left").select("id", "text", "known")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fixed = [restore(t, k or []) for t, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fixed, pa.string())], ["id", "text"])

        return wrong.mapInArrow(run, f"id {self.docs.schema['id'].dataType.simpleString()}, text string")


def restore(text: str, known: list[dict]) -> str:
    """Replace the garbled units of one text; ``known`` are its rows of the hit table."""
    words = {k["unit"]: k["word"] for k in known if k["kind"] == 1}
    forms: dict[str, dict[str, str]] = {}
    votes: dict[str, Counter] = {}
    for k in known:
        if k["kind"] == 0:
            forms.setdefault(k["unit"], {})[k["form"]] = k["word"]
            if k["chain"].split(">")[0] in WIDE_WRITTEN:
                votes.setdefault(k["unit"], Counter())[k["chain"]] += 1
    # Encodings of wide scripts share some rows; the chain that explains most of a run is meant.
    wide = {u: max(sorted(v), key=lambda c: v[c]) for u, v in votes.items()}

    def unit(match: re.Match) -> str:
        run = match.group()
        table = forms.get(run)
        if not table:
            return run
        if run in table:
            return table[run]
        if run in wide:
            written, read = wide[run].split(">")
            try:
                back = {c: b for b, c in enumerate(reading(read))}
                return bytes(back[c] for c in run).decode(written)
            except (KeyError, UnicodeDecodeError):
                pass
        out, at = [], 0
        while at < len(run):
            size = next((n for n in range(min(LONGEST_CHARACTER, len(run) - at), 1, -1) if run[at : at + n] in table), 0)
            out.append(table[run[at : at + size]] if size else run[at])
            at += size or 1
        return "".join(out)

    return _TOKEN.sub(lambda m: words[m.group()] if m.group() in words else _UNIT.sub(unit, m.group()), text)
