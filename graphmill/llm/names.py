"""Variant spellings of names: phonetic blocks, Jaro-Winkler and nicknames, connected components.

A name is a set of tokens.  Tokens met with many different others are common
ones (given names, words of institutions); the rest carry the identity and are
called stems.  Stems are blocked by their phonetic code; two names with equal
or barely different stems are compared token by token.  Initials and unknown
short forms link only where one entity alone fits them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.runs import by_key
from graphmill.operators.components import connected_components
from graphmill.session import materialize

# Words that say nothing about who is meant, and legal forms with their abbreviations.
TITLES = {"dr", "prof", "professor", "doctor", "mr", "mrs", "ms", "miss", "sir", "dame", "rev", "hon", "phd", "md", "jr", "sr"}
FILLERS = {"the", "of", "for", "de", "der", "die", "das", "la", "le", "von", "van"}
LEGAL = {
    "corporation": "corporation", "corp": "corporation",
    "company": "company", "co": "company",
    "limited": "limited", "ltd": "limited",
    "incorporated": "incorporated", "inc": "incorporated",
    "gesellschaft": "gesellschaft", "ges": "gesellschaft", "gmbh": "gesellschaft",
    "aktiengesellschaft": "aktiengesellschaft", "ag": "aktiengesellschaft",
    "plc": "plc", "llc": "llc",
}
# Letters that have no decomposition.
LETTERS = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "ð": "d", "ı": "i"})

# Common English short forms that a given table of them may lack.
SHORT_FORMS = """
Abigail: Abby, Gail. Alexander: Alex, Sandy. Andrew: Andy, Drew. Anthony: Tony. Barbara: Barb, Babs. Benjamin: Ben, Benny.
Bernard: Bernie. Cassandra: Cass, Cassie. Charles: Charlie, Chuck, Chas. Christopher: Chris, Kit. Constance: Connie.
Daniel: Dan, Danny. Deborah: Deb, Debbie. Donald: Don, Donnie. Dorothy: Dot, Dolly, Dottie. Edward: Ed, Eddie, Ned, Ted.
Eleanor: Ellie, Nell. Elizabeth: Liz, Lizzie, Beth, Betty, Libby, Eliza. Eugene: Gene. Florence: Flo, Florrie. Francis: Frank.
Frederick: Fred, Freddie. Gabriel: Gabe. Gerald: Gerry, Jerry. Gregory: Greg. Gwendolyn: Gwen. Helena: Lena. Henry: Harry, Hank.
Isabella: Bella, Izzy. Jacqueline: Jackie, Jacqui. James: Jim, Jimmy, Jamie. John: Jack, Johnny. Jonathan: Jon, Jonny. Joseph: Joe, Joey.
Judith: Judy. Julian: Jules. Katherine: Kate, Kathy, Katie, Kit. Kenneth: Ken, Kenny. Lawrence: Larry. Leonard: Leo, Len, Lenny. Louisa: Lou.
Lucille: Lucy. Margaret: Maggie, Meg, Peggy, Marge. Martha: Marty, Patty. Matthew: Matt. Maximilian: Max. Melissa: Mel. Michael: Mike, Mick, Mickey.
Montgomery: Monty. Nathaniel: Nate, Nat. Nicholas: Nick. Oliver: Ollie. Pamela: Pam. Patricia: Pat, Patty, Trish. Penelope: Penny. Peter: Pete.
Philippa: Pip, Pippa. Priscilla: Cilla. Raymond: Ray. Rebecca: Becky, Becca. Richard: Dick, Rick, Rich. Robert: Bob, Bobby, Rob. Ronald: Ron, Ronnie.
Rosalind: Roz. Samuel: Sam. Sebastian: Seb. Stephen: Steve. Susannah: Sue, Susie. Tabitha: Tabby. Theodore: Ted, Theo. Thomas: Tom, Tommy.
Timothy: Tim. Valentina: Val. Victoria: Vicky, Vic, Tori. Vincent: Vince. Walter: Walt, Wally. Wilhelmina: Mina, Minnie. William: Bill, Billy, Will.
Winifred: Winnie. Zachary: Zack, Zach.
"""

#: A token met with more other tokens than this, and than this share of all distinct sets of tokens, is common.
#: Given names and words of institutions are met with a share of the names that does not fall as the
#: table grows (2 in 1,000 and more here), family names and made-up words with few, whatever its size.
COMMON, COMMON_SHARE = 12, 1 / 2000
#: A component with more spellings than this is given by its accepted pairs, not by all its pairs.
ALL_PAIRS = 100
FULL, WEAK = 1, 2
#: Types of which a word may be written as its initial, and those of persons; untyped words may be either.
INITIALLED, BORN = {"PERSON", "LOCATION", None}, {"PERSON", None}

_WORDS = re.compile(r"[^\W_]+")
_OWNER = re.compile(r"['’`´]s\b")


def fold(name: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", name.translate(LETTERS)) if not unicodedata.combining(c)).lower()


def tokens(name: str) -> list[str]:
    return _WORDS.findall(_OWNER.sub("", fold(name)))


# Sounds written in several ways.
_SOUNDS = (("ph", "f"), ("ck", "k"), ("sch", "s"), ("sh", "s"), ("th", "t"), ("qu", "k"), ("q", "k"), ("c", "k"), ("z", "s"), ("x", "ks"), ("w", "v"), ("j", "g"), ("y", "i"))


def phonetic(token: str) -> str:
    """First letter and consonants, by sound, without doubles."""
    for spelling, sound in _SOUNDS:
        token = token.replace(spelling, sound)
    rest = re.sub(r"[aeiouh]", "", token[1:])
    return re.sub(r"(.)\1+", r"\1", token[:1] + rest)


def blocks(token: str) -> set[str]:
    """The phonetic code, and the code without each one of its letters, so that one wrong letter keeps a block in common."""
    code = phonetic(token)
    short = {re.sub(r"(.)\1+", r"\1", code[:i] + code[i + 1 :]) for i in range(len(code))} if len(code) > 2 else set()
    return {code} | short


def within_one(a: str, b: str) -> bool:
    """At most one insertion, deletion, change or swap of neighbours apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    window = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, mine = [False] * len(b), []
    for i, ch in enumerate(a):
        for k in range(max(0, i - window), min(len(b), i + window + 1)):
            if not taken[k] and b[k] == ch:
                taken[k] = True
                mine.append(ch)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [b[k] for k in range(len(b)) if taken[k]]
    t = sum(x != y for x, y in zip(mine, theirs)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * weight * (1 - jaro)


def slip(a: str, b: str) -> bool:
    """Whether two words are one apart by a slip of the pen; short ones must begin alike."""
    short = min(len(a), len(b))
    if short < 2 or not within_one(a, b):
        return False
    return jaro_winkler(a, b) >= 0.85 if short >= 4 else a[0] == b[0] and max(len(a), len(b)) >= 3


def abbreviates(short: str, long: str) -> bool:
    """``inst`` or ``ctr`` for institute or centre: same first letter, a beginning or letters in order."""
    if len(short) < 2 or len(short) >= len(long) or short[0] != long[0]:
        return False
    if long.startswith(short):
        return True
    letters = iter(long)
    return len(short) <= 4 and len(long) >= len(short) + 2 and short[-1] not in "aeiou" and all(c in letters for c in short)


class Nicknames:
    """Short forms of given names: the same full name, or a full name and its short form."""

    def __init__(self, rows: list[tuple[str, str]], more: str = SHORT_FORMS) -> None:
        self.full: dict[str, set[str]] = {}
        general = [(g, x) for g, forms in re.findall(r"(\w+): ([\w, ]+)\.", more) for x in forms.split(", ")]
        for given, short in [*rows, *general]:
            if given and short:
                g, s = fold(given.strip()), fold(short.strip())
                self.full.setdefault(s, set()).add(g)
                self.full.setdefault(g, set()).add(g)

    def same(self, a: str, b: str) -> bool:
        return bool(self.full.get(a, {a}) & self.full.get(b, {b}))


def _side(words: list[dict], stem: str) -> tuple[list[tuple[str, bool, str | None]], set[str], bool]:
    """What a name holds besides its stem: tokens (word, common, type), legal forms, and whether it has a title."""
    rest, legal, title, seen = [], set(), False, False
    for w in words:
        if w["t"] == stem and not seen:
            seen = True
        elif w["t"] in TITLES:
            title = True
        elif w["t"] in LEGAL:
            legal.add(LEGAL[w["t"]])
        elif w["t"] not in FILLERS:
            rest.append((w["t"], w["common"], w["type"]))
    return rest, legal, title


def compare(a: list[dict], b: list[dict], stem_a: str, stem_b: str, nick: Nicknames) -> int:
    """FULL if two names with matching stems are spellings of one, WEAK if one may be short for the other, else 0."""
    ra, la, ta = _side(a, stem_a)
    rb, lb, tb = _side(b, stem_b)
    # Given name and short form side by side, as in Louisa "Lou" Figrevest: the short form adds nothing.
    ra, rb = ([x for x in side if not any(len(y[0]) > len(x[0]) > 1 and nick.same(x[0], y[0]) for y in side)] for side in (ra, rb))
    if la and lb and la != lb:
        return 0
    typos = int(stem_a != stem_b)
    if not ra and not rb:
        return FULL if (not typos or len(la | lb) == 1) and not (la != lb and (ta or tb)) else 0
    if not ra or not rb:
        # A title and a family name alone: whoever has that name.
        titled, other = (ta, rb) if not ra else (tb, ra)
        return WEAK if titled and not typos and not (la or lb) and other and all(k in BORN for _, _, k in other) else 0
    if len(ra) > len(rb):
        ra, rb = rb, ra
    if len(ra) == 1 and len(rb) > 1 and 2 <= len(ra[0][0]) <= 6 and not ra[0][1] and not typos:
        if ra[0][0] == "".join(w[0] for w, _, _ in rb):
            return FULL
    # Only the first initial of a name can stand for a given name.
    lead = {next((w for w, _, _ in side if len(w) == 1), "") for side in (ra, rb)}
    left, initial = list(rb), False
    used_initials = 0
    for word, common, kind in sorted(ra, key=lambda x: -len(x[0])):
        best, how = None, 0
        for k, (other, other_common, other_kind) in enumerate(left):
            if word == other:
                score = 5
            elif nick.same(word, other):
                score = 4
            elif len(word) > 1 and len(other) > 1 and (abbreviates(word, other) or abbreviates(other, word)):
                score = 3
            elif not (common and other_common) and slip(word, other):
                score = 2
            elif 1 in (len(word), len(other)) and word[0] == other[0] and len(word) != len(other) and min(word, other, key=len) in lead and (other_kind if len(word) == 1 else kind) in INITIALLED:
                score = 1
            elif min(len(word), len(other)) >= 3 and word[0] == other[0] and kind in BORN and other_kind in BORN and common != other_common and jaro_winkler(word, other) >= 0.7:
                score = 0.5
            else:
                continue
            if score > how:
                best, how = k, score
        if best is None:
            # A middle initial that the other name has not.
            if len(word) == 1 and any(len(w) > 1 for w, _, _ in ra):
                used_initials += 1
                continue
            return 0
        typos += how == 2
        initial |= how <= 1
        left.pop(best)
    if any(len(w) > 1 for w, _, _ in left) or typos > 1:
        return 0
    if left and all(len(w) == 1 for w, _, _ in ra):
        initial = True
    return WEAK if initial else FULL


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tokens(n) for n in batch.column(0).to_pylist()], pa.list_(pa.string()))], ["name", "tokens"])


def _keys(kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [sorted(kind(t)) for t in batch.column(0).to_pylist()]
            row = pa.array([i for i, k in enumerate(keys) for _ in k], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x for k in keys for x in k], pa.string()), *(c.take(row) for c in batch.columns)], ["key", *batch.schema.names])

    return run


def _close_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Close token pairs that have a phonetic block in common, from the tokens of each spelling with one letter left out.

    All tokens one apart share such a spelling, and a spelling has but few tokens: one for each letter put in at each place.
    """
    key, seen = None, []
    for batch in batches:
        a, b = [], []
        for k, token in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key:
                key, seen = k, []
            for other in seen:
                if within_one(token, other) and jaro_winkler(token, other) >= 0.85 and blocks(token) & blocks(other):
                    a.append(min(token, other))
                    b.append(max(token, other))
            seen.append(token)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])


def _spellings(token: str) -> set[str]:
    return {token} | {token[:i] + token[i + 1 :] for i in range(len(token))}


def variants(names: DataFrame, nicknames: DataFrame, name_col: str = "name", type_col: str = "entity_type", more_short_forms: str = SHORT_FORMS) -> DataFrame:
    """``(name_a, name_b)`` with name_a < name_b: accepted pairs of spellings.

    ``names`` holds every occurrence with its type; null and blank names, and
    names without a letter or digit, take no part.  Names that differ in case,
    blanks or accents only are always linked.  The nickname table is small and
    fixed; it is read by the driver up to 10,000 rows.  ``more_short_forms`` adds
    common English ones that it may lack; "" adds none.
    """
    known = nicknames.select("given_name", "short_form").limit(10_001).collect()
    if len(known) > 10_000:
        raise ValueError("the nickname table has more than 10,000 rows")
    nick = Nicknames([tuple(r) for r in known], more_short_forms)

    typed = names.select(F.col(name_col).alias("name"), F.col(type_col).alias("type")).where("name is not null")
    kinds = typed.groupBy("name").agg(F.mode("type", True).alias("type"))
    parsed = materialize(kinds.select("name").mapInArrow(_tokenise, "name string, tokens array<string>").where(F.size("tokens") > 0).join(kinds, "name"), "parsed")

    # How many other tokens a token is met with, and names of which type have it most.
    each = parsed.select(F.explode(F.array_distinct("tokens")).alias("token"), "tokens", "type")
    met = each.select("token", F.explode(F.array_distinct("tokens")).alias("other")).where("token != other").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("partners"))
    use = each.groupBy("token").agg(F.mode("type", True).alias("type"))
    fixed = nicknames.select(F.explode(F.array("given_name", "short_form")).alias("token")).where("token is not null").select(F.lower(F.trim("token")).alias("token")).distinct().withColumn("listed", F.lit(True))
    stats = use.join(met, "token", "left").join(fixed, "token", "left")
    forms = parsed.select(F.array_join(F.array_sort("tokens"), " ").alias("form")).agg(F.count_distinct("form")).first()[0]
    common = (F.coalesce("partners", F.lit(0)) > max(COMMON, COMMON_SHARE * forms)) | F.col("listed").isNotNull() | (F.length("token") == 1) | F.col("token").isin(*TITLES, *FILLERS, *LEGAL)
    stats = materialize(stats.select("token", F.coalesce("partners", F.lit(0)).alias("partners"), "type", common.alias("common")), "tokens")

    # Misspelled common tokens: one letter off a token that is met ten times as widely.
    spelled = lambda df: df.mapInArrow(_keys(_spellings), "key string, token string, partners bigint")
    rare = spelled(stats.where("not common and length(token) >= 4").select("token", "partners"))
    wide = spelled(stats.where("common and length(token) >= 4").select("token", "partners")).withColumnsRenamed({"token": "meant", "partners": "wide"})

    @F.pandas_udf("boolean")
    def one_apart(a, b):
        import pandas as pd

        return pd.Series([within_one(x, y) for x, y in zip(a, b)])

    meant = rare.hint("merge").join(wide, "key").where(F.col("wide") >= 10 * F.col("partners")).select("token", "meant", "wide").distinct().where(one_apart("token", "meant"))
    meant = meant.groupBy("token").agg(F.max_by("meant", F.struct("wide", "meant")).alias("meant"))
    info = stats.join(meant, "token", "left")
    right = info.select("token", F.coalesce("meant", "token").alias("t"), (F.col("common") | F.col("meant").isNotNull()).alias("common"), "type")

    words = parsed.select("name", F.posexplode("tokens").alias("pos", "token")).join(right, "token")
    whole = words.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("pos", "t", "common", "type"))).alias("w"))
    # The stem is the longest token that is not common; a name of common tokens alone has its longest token.
    longest = F.array_max(F.transform(F.col("w"), lambda x: F.struct((~x["common"]).alias("rare"), F.length(x["t"]).alias("n"), x["t"].alias("t"))))
    form = F.array_join(F.array_sort(F.transform("w", lambda x: x["t"])), " ")
    stemmed = materialize(whole.select("name", "w", longest["t"].alias("stem"), form.alias("form")), "stemmed")

    # One representative of names with the same tokens; hot forms stay linear.
    reps = materialize(stemmed.groupBy("form").agg(F.min("name").alias("rep"), F.min_by(F.struct("w", "stem"), "name").alias("x")).select("rep", "x.w", "x.stem"), "reps")
    same = stemmed.join(reps.select("rep", F.array_join(F.array_sort(F.transform("w", lambda x: x["t"])), " ").alias("form")), "form").where("name != rep").select(F.col("rep").alias("a"), F.col("name").alias("b"))

    stems = reps.select("stem").distinct().where("length(stem) >= 4").withColumnRenamed("stem", "token")
    close = by_key(stems.mapInArrow(_keys(_spellings), "key string, token string"), "key", "token").mapInArrow(_close_stems, "a string, b string").distinct()
    alike = close.unionByName(reps.select(F.col("stem").alias("a"), F.col("stem").alias("b")).distinct())
    left = reps.select(F.col("rep").alias("name_a"), F.col("w").alias("wa"), F.col("stem").alias("a"))
    other = reps.select(F.col("rep").alias("name_b"), F.col("w").alias("wb"), F.col("stem").alias("b"))
    pairs = alike.join(left, "a").join(other, "b").where((F.col("a") != F.col("b")) | (F.col("name_a") < F.col("name_b"))).select("name_a", "name_b", "wa", "wb", "a", "b")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                cols = [c.to_pylist() for c in part.columns]
                link = [compare(x, y, s, t, nick) for x, y, s, t in zip(cols[2], cols[3], cols[4], cols[5])]
                keep = pa.array([i for i, v in enumerate(link) if v], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep), pa.array([v for v in link if v], pa.int32())], ["a", "b", "link"])

    # Pairs are judged in even shares, however many names one stem has.
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    judged = materialize(pairs.repartition(tasks, "name_a", "name_b").mapInArrow(judge, "a string, b string, link int"), "judged")
    full = judged.where(F.col("link") == FULL).select("a", "b")
    groups = materialize(connected_components(full, "a", "b"), "groups")

    # A weak link holds where all weak links of the shorter name to names that are more than initials lead to one group.
    spelt = F.exists("w", lambda x: (F.length(x["t"]) > 1) & (x["t"] != F.col("stem")) & ~x["t"].isin(*TITLES, *FILLERS))
    whole_names = reps.where(spelt).select(F.col("rep").alias("node"))
    size = reps.select(F.col("rep").alias("node"), F.aggregate(F.transform("w", lambda x: F.length(x["t"])), F.lit(0), lambda s, n: s + n).alias("letters"))
    weak = judged.where(F.col("link") == WEAK).select("a", "b")
    weak = weak.join(size.withColumnsRenamed({"node": "a", "letters": "la"}), "a").join(size.withColumnsRenamed({"node": "b", "letters": "lb"}), "b")
    weak = weak.select(F.when(F.col("la") <= F.col("lb"), F.col("a")).otherwise(F.col("b")).alias("short"), F.when(F.col("la") <= F.col("lb"), F.col("b")).otherwise(F.col("a")).alias("node"))
    led = weak.join(whole_names, "node", "left_semi").join(groups, "node", "left").withColumn("to", F.coalesce("component", "node"))
    sole = led.groupBy("short").agg(F.min("to").alias("least"), F.max("to").alias("most"), F.min("node").alias("node")).where("least = most")
    edges = full.unionByName(sole.select(F.col("short").alias("a"), F.col("node").alias("b"))).unionByName(same)
    return edges.select(F.least("a", "b").alias("name_a"), F.greatest("a", "b").alias("name_b")).distinct()


def variant_pairs(links: DataFrame) -> DataFrame:
    """``(name_a, name_b)``: all pairs of names that ``variants`` connects.

    A component of more than ``ALL_PAIRS`` spellings is given by its links.
    """
    stored = materialize(links, "links")
    groups = materialize(connected_components(stored, "name_a", "name_b"), "spellings")
    few = groups.join(groups.groupBy("component").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= ALL_PAIRS), "component").select("component", F.col("node").alias("name_a"))
    all_pairs = few.join(few.withColumnRenamed("name_a", "name_b"), "component").where("name_a < name_b").select("name_a", "name_b")
    rest = stored.join(few.select("name_a"), "name_a", "left_anti").select("name_a", "name_b")
    return all_pairs.unionByName(rest)


def variant_groups(links: DataFrame) -> DataFrame:
    """``(name, group_name, links)`` of every name that has a variant: the smallest name of its component, and its accepted links."""
    stored = materialize(links, "links")
    groups = connected_components(stored, "name_a", "name_b")
    degree = stored.select(F.explode(F.array("name_a", "name_b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    return groups.join(degree, "node").select(F.col("node").alias("name"), F.col("component").alias("group_name"), "links")
