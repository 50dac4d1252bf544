"""Normalization of text as column expressions. Only NFKC needs Python, since Spark has no such function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The character sets that the normal forms strip.
SENTENCE_END = "。．.!！?？"
SURFACE_END = "、，,。．.!！?？:：;；"
SIMILARITY_DROPPED = r"[。、,.!?！？:：;；「」『』（）()\[\]{}]"
SPACE = r"[\s\p{Z}]"
ASCII_SPACES = " \t\n\v\f\r"
SPACES = ASCII_SPACES + "\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"  # all that SPACE matches


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row, as a lambda's variable: nested rules otherwise repeat it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends. Only the ends are looked at; a pattern would try every place."""
    return F.btrim(text, F.lit(SPACES))


def fragment(text: Column) -> Column:
    """NFKC, then white space and sentence ends stripped at both ends."""
    return plain_fragment(nfkc(text))


def plain_fragment(text: Column) -> Column:
    """N1 for text that is in NFKC already: stays inside the JVM."""
    return strip(F.btrim(strip(text), F.lit(SENTENCE_END)))


def surface(text: Column) -> Column:
    """NFKC, stripped, without separators and sentence ends at the right."""
    return plain_surface(nfkc(text))


def plain_surface(text: Column) -> Column:
    """N2 for text that is in NFKC already: stays inside the JVM."""
    return strip(F.rtrim(strip(text), F.lit(SURFACE_END)))


def collapse(text: Column) -> Column:
    """Every run of white space is one space; none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def queue_key(text: Column) -> Column:
    """N3 in lower case."""
    return F.lower(collapse(text))


def similarity_key(text: Column) -> Column:
    """Lower case without white space and punctuation."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), rf"{SPACE}+", ""), SIMILARITY_DROPPED, "")


def prompt_key(text: Column) -> Column:
    """Half-width question marks, no white space, no sentence end, lower case."""
    bare = F.regexp_replace(F.translate(text, "？", "?"), rf"{SPACE}+", "")
    return F.lower(F.regexp_replace(bare, r"[。.!！?？]+$", ""))


def clean_slot(text: Column) -> Column:
    """Without one trailing particle. A particle alone stays: an empty slot would be in every answer."""
    return strip(F.regexp_replace(strip(text), "(?s)^(.+)(?:を|は|が|の)$", "$1"))


def clean_statement(text: Column) -> Column:
    """Without bullets at the front, white space collapsed."""
    return collapse(F.regexp_replace(collapse(text), r"^[・＊*#>\-\s]+", ""))


def first_line(text: Column) -> Column:
    """Up to the first line end or role marker."""
    return strip(F.regexp_replace(text, r"(?s)(?:\r?\n|人:|AI:).*$", ""))


def truth_state(text: Column) -> Column:
    """Upper case; an unknown state is an error."""
    up = F.upper(strip(text))
    known = up.isin("TRUE", "FALSE", "UNVERIFIED", "CONTESTED", "OUTDATED")
    return F.when(known, up).otherwise(F.raise_error(F.concat(F.lit("unsupported truth state: "), up)))


def predicate_type(text: Column) -> Column:
    """Lower case; an unknown type is a property."""
    low = F.lower(strip(text))
    return F.when(low.isin("definition", "property", "capability", "relation"), low).otherwise("property")


def pair_fingerprint(user: Column, answer: Column) -> Column:
    """sha256 of both collapsed texts, a line feed between."""
    return F.sha2(F.concat(collapse(user), F.lit("\n"), collapse(answer)), 256)


def hash_bucket(key: Column, buckets: int = 10_000) -> Column:
    """The first eight bytes of sha256, big-endian, modulo the number of buckets."""
    head = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % buckets).cast("int")


def char_ngrams(text: Column, n: int = 2) -> Column:
    """Distinct n-grams of N4; a shorter text as a whole; none of an empty one. Characters are cut once and shifted
    copies of them joined, so the work grows with the length alone."""

    def grams(key: Column, chars: Column) -> Column:
        count = F.size(chars) - F.lit(n - 1)
        found = F.slice(chars, F.lit(1), count)
        for i in range(2, n + 1):
            found = F.zip_with(found, F.slice(chars, F.lit(i), count), lambda a, b: F.concat(a, b))
        return F.when(count > 0, F.array_distinct(found)).otherwise(F.array(key))

    none = F.array().cast("array<string>")
    return let(similarity_key(text), lambda key: F.when(key != "", let(F.split(key, ""), lambda chars: grams(key, chars))).otherwise(none))


def three_places(x: Column) -> Column:
    """A double with three decimals as Python and printf write it: rounded by its binary value, ties to even, where
    format_string rounds the decimal form half up (0.3125: 0.313). The value is cut in two parts of few bits, so that its
    distance from the middle of two thousandths has the right sign."""

    def written(p: Column) -> Column:
        above = (p["a"] * 2000 - (p["n"] * 2 + 1)) + p["b"] * 2000
        n = p["n"] + ((above > 0) | ((above == 0) & (p["n"] % 2 == 1))).cast("long")
        return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(n / 1000).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))

    size, short = F.abs(x), F.abs(x).cast("float").cast("double")
    return let(F.struct(short.alias("a"), (size - short).alias("b"), F.floor(size * 1000).alias("n")), written)


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a part."""
    gone = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.when(F.length(part) > 0, gone / F.length(part)).otherwise(0).cast("long")


def sentences(text: Column) -> Column:
    """Pieces after sentence ends and line ends, stripped, the empty ones dropped. Without lookbehind, so that the
    same can be said in SQL."""
    cut = F.split(F.regexp_replace(text, r"([。！？!?.])", "$1\n"), r"[\r\n]+")
    return F.filter(F.transform(cut, strip), lambda s: F.length(s) > 0)

