"""Text columns: folding, ids, markup, cutting at sentences, numbers, abbreviations, and what answers are checked with."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words after a number and what they multiply it by.
SCALES = {"thousand": 1e3, "k": 1e3, "million": 1e6, "m": 1e6, "billion": 1e9, "bn": 1e9}
NUMBER = r"([0-9][0-9,]*(?:\.[0-9]+)?)"
SCALED = NUMBER + r"(?: ?(thousand|million|billion|bn|k|m)\b)?"


def fold_of(text: str) -> str:
    """Lower-case letters and digits without marks."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]", "", plain.lower())


@F.arrow_udf(T.StringType())
def fold(texts: pa.Array) -> pa.Array:
    known = texts.dictionary_encode()
    folded = pa.array([fold_of(x) if x is not None else None for x in known.dictionary.to_pylist()], pa.string())
    return folded.take(known.indices)


def link_id(url: Column) -> Column:
    """language/number of a page's address, without host, query and version."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    return F.concat_ws("/", F.regexp_extract(bare, r"/([a-z]{2})/[0-9]+", 1), F.regexp_extract(bare, r"/([0-9]+)(?:v[0-9]+)?$", 1))


def without_markup(html: Column) -> Column:
    """Text without scripts, tags, entities and a leading label, one space between words."""
    text = F.regexp_replace(html, r"(?is)<(?:script|style)\b.*?</(?:script|style)>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<[^>]*>", " "), r"&[a-zA-Z0-9#]+;", " ")
    text = F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0B]+", " "))
    return F.regexp_replace(text, r"^(?i:abstract|summary)[:.] ?", "")


def cut(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, ending at a sentence where one is near."""
    text = F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0B]+", " "))
    head = F.left(text, F.lit(limit))
    sentence = F.regexp_extract(head, r"(?s)^(.*\.) ", 1)
    short = F.when(F.length(sentence) > int(limit * 0.6), sentence).otherwise(F.rtrim(head))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(short, F.lit(" [...]")))


def numbers(text: Column) -> Column:
    """The numbers of a text, those before a scale word multiplied by it."""
    lower = F.lower(text)
    values = F.regexp_extract_all(lower, F.lit(SCALED), F.lit(1))
    scales = F.regexp_extract_all(lower, F.lit(SCALED), F.lit(2))
    factor = F.create_map(*[F.lit(x) for pair in SCALES.items() for x in pair])
    return F.zip_with(values, scales, lambda v, s: F.regexp_replace(v, ",", "").cast("double") * F.coalesce(F.try_element_at(factor, s), F.lit(1.0)))


def grounded(stated: Column, known: Column) -> Column:
    """Whether a stated number is a known one: equal, as a percentage, or rounded to three digits or more of it."""
    near = lambda a, b: F.abs(a - b) <= F.abs(b) * 0.0005 + 1e-9
    return F.exists(known, lambda k: near(stated, k) | near(stated, k * 100) | (F.abs(stated - k) < 0.05 * F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(F.abs(k), F.lit(1.0)))) - 2)))


def abbreviates(short: Column, full: Column) -> Column:
    """Whether the words of ``short``, without points, begin words of ``full`` in order."""
    words = F.filter(F.split(F.lower(F.regexp_replace(short, r"\.", " ")), " +"), lambda w: w != "")
    pattern = F.concat(F.lit("(^| )"), F.array_join(F.transform(words, lambda w: F.concat(F.regexp_replace(w, r"([^a-z0-9])", r"\\$1"), F.lit("[^ ]*"))), " (?:.* )?"))
    return F.rlike(F.lower(full), pattern)


# Answers


def answer_right(kind: str, answer: str | None, expected: str | None) -> bool:
    """Whether an answer states what was expected: a number, all of some names, or a venue with its year."""
    if not answer or not expected:
        return False
    if kind == "number":
        want = float(expected.replace(",", ""))
        return any(float(n.replace(",", "")) == want for n in re.findall(NUMBER, answer))
    folded = fold_of(answer)
    if kind == "names":
        return all(fold_of(n) in folded for n in expected.split(";"))
    venue, _, year = expected.rpartition(" ")
    return fold_of(venue) in folded and re.search(rf"(?<!\d){re.escape(year)}(?!\d)", answer) is not None


@F.arrow_udf(T.BooleanType())
def right(kind: pa.Array, answer: pa.Array, expected: pa.Array) -> pa.Array:
    return pa.array([answer_right(k, a, e) for k, a, e in zip(kind.to_pylist(), answer.to_pylist(), expected.to_pylist(), strict=True)], pa.bool_())


def citations_valid(answer: Column, sources: Column) -> Column:
    """Whether an answer cites at all, and every [n] is one of so many sources."""
    cited = F.transform(F.regexp_extract_all(answer, F.lit(r"\[([0-9]{1,4})\]"), F.lit(1)), lambda n: n.cast("int"))
    return (F.size(cited) > 0) & F.forall(cited, lambda n: (n >= 1) & (n <= sources))
