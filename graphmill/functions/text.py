"""Text functions on columns; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop words of keyword search, of TF-IDF keywords (with the additions), of
# plain frequency keywords, and of concepts.
SEARCH_STOP_WORDS = """
the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she or an will my one all
would there their what so up out if about who get which go me when make can like time no just him know take people into year your good
some could them see other than then now look only come its over think also back after use two how our work first well way even new want
because any these give day most us
""".split()
KEYWORD_STOP_WORDS = SEARCH_STOP_WORDS + "is was are been has had were said did".split()
PLAIN_STOP_WORDS = """
the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she or an will my one all
would there their what so up out if about who get which go me
""".split()
CONCEPT_STOP_WORDS = """
the a an and or but in on at to for of with by from as is was are were be been being have has had do does did will would should could
may might must can this that these those it its i you he she we they them their what which who when where why how all each every both
few more most other some such no nor not only own same so than too very just now
""".split()


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(text: str | Column) -> Column:
    """White space collapsed and trimmed; null stays null."""
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))


def split_words(text: str | Column) -> Column:
    """The pieces between runs of white space; none for null or blank text."""
    t = F.coalesce(_col(text), F.lit(""))
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def word_count(text: str | Column) -> Column:
    return F.size(split_words(text))


def sentences(text: str | Column) -> Column:
    """Pieces between ``.``, ``!`` and ``?``, trimmed, without empty ones."""
    t = F.coalesce(_col(text), F.lit(""))
    return F.filter(F.transform(F.split(t, "[.!?]"), clean), lambda s: s != "")


def sentences_kept(text: str | Column) -> Column:
    """Sentences with their end mark."""
    t = F.coalesce(_col(text), F.lit(""))
    return F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"[^.!?]+[.!?]?"), F.lit(0)), clean), lambda s: s != "")


def _bare_words(text: Column, kept: str) -> Column:
    """Words of a text from which all but letters, digits, ``kept`` and white space is removed first."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), rf"[^\p{{L}}\p{{N}}{kept}\s]", "")
    return F.split(bare, r"\s+")


def search_tokens(text: str | Column) -> Column:
    """Tokens of keyword search: lower case, letters and digits, more than two bytes, no stop word."""
    return F.filter(_bare_words(F.lower(_col(text)), ""), lambda w: (F.octet_length(w) > 2) & ~w.isin(*SEARCH_STOP_WORDS))


def keyword_tokens(text: str | Column) -> Column:
    """Tokens of TF-IDF keywords: as in search, but with ``-`` and ``_``, and without pure numbers."""
    return F.filter(_bare_words(F.lower(_col(text)), r"_\-"), lambda w: (F.octet_length(w) > 2) & ~w.isin(*KEYWORD_STOP_WORDS) & ~w.rlike(r"^\p{N}+$"))


def plain_tokens(text: str | Column) -> Column:
    """Tokens of plain frequency keywords: lower-case words of more than three bytes, no stop word."""
    return F.filter(split_words(F.lower(_col(text))), lambda w: (F.octet_length(w) > 3) & ~w.isin(*PLAIN_STOP_WORDS))


def detect_language(text: str | Column) -> Column:
    """Guess by accents, in this order: Spanish, Portuguese, French, else English."""
    t = _col(text)
    return F.when(t.rlike("[ñóéíáú]"), "es").when(t.rlike("[çãõ]"), "pt").when(t.rlike("[àèùò]"), "fr").otherwise("en")


def normalize_name(name: str | Column) -> Column:
    """Lower case, only letters, digits and ``_``: the name part of an entity id."""
    return F.regexp_replace(F.lower(_col(name)), r"[^\p{L}\p{N}_]", "")


def entity_id(kind: str | Column, name: str | Column) -> Column:
    return F.concat(_col(kind), F.lit("_"), normalize_name(name))


def normalize_for_linking(text: str | Column) -> Column:
    """Lower case without punctuation, blanks collapsed."""
    return clean(F.regexp_replace(F.lower(_col(text)), r"[^\p{L}\p{N}\s]", ""))


def heading_level(line: str | Column) -> Column:
    """1 to 6 for a markdown heading, else null."""
    n = F.length(F.regexp_extract(_col(line), r"^(#{1,6})\s", 1))
    return F.when(n > 0, n)


def is_all_caps(line: str | Column) -> Column:
    t = _col(line)
    return t.rlike(r"\p{L}") & (t == F.upper(t))


def is_underline(line: str | Column) -> Column:
    return F.trim(_col(line)).rlike(r"^(={3,}|-{3,})$")


def section_number(text: str | Column) -> Column:
    """Number at the start of a heading: ``1.2.3``, ``IV.``, ``B)`` or that after a word for chapter; null without."""
    t = F.trim(_col(text))
    decimal = F.regexp_extract(t, r"^(\d+(?:\.\d+)*)[.)]?\s", 1)
    roman = F.regexp_extract(t, r"^([IVXLCDM]+)[.)]\s", 1)
    letter = F.regexp_extract(t, r"^([A-Z])[.)]\s", 1)
    chapter = F.regexp_extract(t, r"(?i)^(?:chapter|section|part)\s+(\d+|[ivxlcdm]+)\b", 1)
    return F.coalesce(*[F.when(x != "", x) for x in (decimal, chapter, roman, letter)])


def roman_value(numeral: str | Column) -> Column:
    """The number that a Roman numeral stands for; null if it is none."""
    n = F.upper(_col(numeral))
    value = F.create_map(*[F.lit(x) for x in ("I", 1, "V", 5, "X", 10, "L", 50, "C", 100, "D", 500, "M", 1000)])
    each = F.transform(F.filter(F.split(n, ""), lambda c: c != ""), lambda c: F.element_at(value, c))
    ahead = F.concat(F.slice(each, 2, F.greatest(F.size(each), F.lit(1))), F.array(F.lit(0)))
    signed = F.zip_with(each, ahead, lambda a, b: F.when(a < b, -a).otherwise(a))
    return F.when(n.rlike("^[IVXLCDM]+$"), F.aggregate(signed, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))))


def title_of(text: str | Column) -> Column:
    """The first markdown heading, or else the first line with text."""
    t = F.coalesce(_col(text), F.lit(""))
    heading = F.trim(F.regexp_extract(t, r"(?m)^#{1,6}\s+(.+)$", 1))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(heading != "", heading).otherwise(F.try_element_at(lines, F.lit(1)))


def estimate_tokens(text: str | Column) -> Column:
    return F.floor(F.octet_length(_col(text)) / 4)


def strip_tags(html: str | Column) -> Column:
    return F.regexp_replace(_col(html), "<[^>]*>", "")


def html_headings(html: str | Column) -> Column:
    """Text of all h1 to h6 elements, in order, without tags."""
    found = F.regexp_extract_all(F.coalesce(_col(html), F.lit("")), F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1))
    return F.transform(found, lambda h: F.trim(strip_tags(h)))


def truncate(text: str | Column, characters: int) -> Column:
    return F.substring(_col(text), 1, characters)


def preview(text: str | Column, query: str, width: int = 100) -> Column:
    """``width`` characters around the first query word that occurs, with ``...`` where text is cut."""
    t = F.coalesce(_col(text), F.lit(""))
    places = [F.nullif(F.locate(w, F.lower(t)), F.lit(0)) for w in query.lower().split()]
    at = F.coalesce(F.least(*places) if len(places) > 1 else places[0] if places else F.lit(None), F.lit(1))
    start = F.greatest(at - width // 2, F.lit(1))
    body = t.substr(start, F.lit(width))
    return F.concat(F.when(start > 1, "...").otherwise(""), body, F.when(start + width - 1 < F.length(t), "...").otherwise(""))


def content_signature(text: str | Column) -> Column:
    """Letters and digits of the first 50 characters, ``_`` and the length: equal for results to be merged."""
    t = F.coalesce(_col(text), F.lit(""))
    return F.concat(F.regexp_replace(F.substring(t, 1, 50), r"[^\p{L}\p{N}]", ""), F.lit("_"), F.octet_length(t))


def text_statistics(text: str | Column) -> dict[str, Column]:
    """Words, sentences (at least 1), paragraphs (at least 1), characters, words a sentence, characters a word."""
    t = F.coalesce(_col(text), F.lit(""))
    words = word_count(t)
    marks = F.greatest(F.regexp_count(t, F.lit("[.!?]")), F.lit(1))
    paragraphs = F.greatest(F.size(F.filter(F.split(t, "\n\n"), lambda p: F.trim(p) != "")), F.lit(1))
    return {
        "words": words,
        "sentences": marks,
        "paragraphs": paragraphs,
        "characters": F.length(t),
        "words_per_sentence": words / marks,
        "chars_per_word": F.when(words > 0, F.length(t) / words).otherwise(0.0),
    }


def json_in_markdown(text: str | Column) -> Column:
    """The JSON of a fenced block, or else the text from the first brace to the last; null without."""
    t = F.coalesce(_col(text), F.lit(""))
    fenced = F.trim(F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```", 1))
    braced = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(braced != "", braced)


def fact_time(phrase: str | Column) -> Column:
    """Seconds since 1970 of the first year in a phrase, BC years negative; null without a year."""
    p = _col(phrase)
    year = F.regexp_extract(p, r"(\d{1,4})", 1)
    number = F.when(year != "", year.cast("bigint"))
    signed = F.when(p.rlike(r"(?i)\b(bc|bce|b\.c\.)"), -number).otherwise(number)
    return (signed - 1970) * 365 * 86400


# The closed classes of words, and common open ones, by which a word is tagged.
WORD_CLASSES = {
    "Determiner": "the a an this that these those my your his her its our their some any no every each".split(),
    "Pronoun": "i you he she it we they me him us them who what which whom whose".split(),
    "Preposition": "in on at by for with about against between into through during before after above below to from of off over under".split(),
    "Conjunction": "and or but nor so yet because although while if unless until".split(),
    "Adverb": "not very too also just now then here there always never often only".split(),
    "Verb": "is are was were be been being have has had do does did will would can could shall should may might must go make take see get know".split(),
    "Adjective": "good new first last long great little own other old right big high small large".split(),
}


def word_class(word: str | Column) -> Column:
    """Tag of a word: punctuation, number, known class, proper noun if capitalised, else by its ending, else noun."""
    w = _col(word)
    low = F.lower(w)
    out = F.when(w.rlike(r"^\p{Punct}+$"), "Punctuation").when(w.rlike("^[0-9]+$"), "Number")
    for name, known in WORD_CLASSES.items():
        out = out.when(low.isin(*known), name)
    out = out.when(w.rlike(r"^\p{Lu}"), "ProperNoun").when(low.endswith("ing"), "VerbGerund").when(low.endswith("ed"), "VerbPast")
    out = out.when(low.endswith("s") & ~low.endswith("ss"), "NounPlural").when(low.rlike("(?:ive|ous|ful)$"), "Adjective").when(low.endswith("ly"), "Adverb")
    return out.otherwise("Noun")


def tagged(text: str | Column) -> Column:
    """Words and marks of a text with their tag, as an array of ``(word, tag)``."""
    words = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"), F.lit(0))
    return F.transform(words, lambda w: F.struct(w.alias("word"), word_class(w).alias("tag")))


def noun_phrases(text: str | Column) -> Column:
    """Runs of adjectives and nouns that end with a noun, of two words or more."""
    short = {"Adjective": "A", "Noun": "N", "NounPlural": "N", "ProperNoun": "N"}
    code = F.create_map(*[F.lit(x) for kv in short.items() for x in kv])
    line = F.array_join(F.transform(tagged(text), lambda t: F.concat(F.coalesce(F.try_element_at(code, t["tag"]), F.lit("x")), F.lit("/"), t["word"])), " ")
    runs = F.regexp_extract_all(line, F.lit(r"(?:(?<=^| )[AN]/\S+ )+N/\S+"), F.lit(0))
    return F.transform(runs, lambda r: F.regexp_replace(r, r"(^| )[AN]/", "$1"))
