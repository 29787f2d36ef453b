"""Text normalisation and the small scalar functions of the claim and record builders, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Patterns that decide which texts are claims, cancellations and dependencies.
CLAIM_NUMBER = r"(?U)^\s*(\d{1,3})\s*[.)](?!\d)"
_GAP = r"[\s.:;,\-–—]"
CANCELLATION = rf"(?Ui)^\s*(\d+)(?:{_GAP}+(\d+))?{_GAP}*\(\s*cancell?ed\s*\)"
_NUMBERS = r"([\d\s,;–—\-]+(?:\s*(?:to|through|and|or)\s*\d+)*)"
_ANY = r"(?:any\s+one\s+of\s+|any\s+of\s+|either\s+of\s+)?"
STRONG_REFERENCE = rf"(?Ui)(?:according to|as claimed in|as recited in|as set forth in|as defined in|defined in|recited in|set forth in)\s+{_ANY}(?:claims?\s+)?{_NUMBERS}"
WEAK_REFERENCE = rf"(?Ui)\b(?:of|in)\s+{_ANY}claims?\s+{_NUMBERS}"
NUMBER_RANGE = r"(?Ui)(\d+)\s*(?:to|through|[-–—])\s*(\d+)"
WIDEST_RANGE = 100


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Spark has no Unicode normalisation; plain ASCII passes through untouched."""
    return _nfkc(texts)


@F.pandas_udf(ArrayType(StringType()))
def nfkc_all(arrays: pd.Series) -> pd.Series:
    return arrays.map(lambda a: None if a is None else [t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in a])


def tidy(composed: Column) -> Column:
    """The part of normalisation after NFKC: drops format characters, frees FIG. references, collapses white space."""
    c = F.regexp_replace(F.coalesce(composed, F.lit("")), r"\p{Cf}", "")
    c = F.regexp_replace(c, r"(?<=[a-z])(?=FIGS?\.)", " ")
    c = F.regexp_replace(c, r"(?U)\b(FIGS?\.)\s*(\d)", "$1 $2")
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def normalize_text(c: Column) -> Column:
    """Null and blank give ''."""
    return tidy(nfkc(c.cast("string")))


def is_blank(c: Column) -> Column:
    """As normalize_text(c) = '', without leaving the JVM: nothing but white space and format characters."""
    return ~F.coalesce(c, F.lit("")).rlike(r"(?U)[^\s\x1c-\x1f\p{Cf}]")


def normalize_paragraphs(c: Column) -> Column:
    """Normalised elements without the blank ones, in order; null gives an empty array."""
    normal = F.transform(nfkc_all(c), tidy)
    return F.coalesce(F.filter(normal, lambda t: t != ""), F.array().cast("array<string>"))


def words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def ends_complete(c: Column) -> Column:
    return c.rlike(r"""\.["')]?$""")


def claim_number(c: Column) -> Column:
    """The number an entry begins with, or null."""
    n = F.regexp_extract(c, CLAIM_NUMBER, 1)
    return F.when(n != "", n.cast("int"))


def canceled_range(c: Column) -> Column:
    """(lo, hi) of a cancellation entry, hi = lo for a single claim; null for any other entry."""
    lo, hi = F.regexp_extract(c, CANCELLATION, 1), F.regexp_extract(c, CANCELLATION, 2)
    return F.when(lo != "", F.struct(lo.cast("int").alias("lo"), F.when(hi == "", lo).otherwise(hi).cast("int").alias("hi")))


def dependencies(c: Column) -> Column:
    """Sorted distinct claim numbers that a claim refers to. A range that runs backwards or is too wide counts for nothing."""
    found = F.concat(F.regexp_extract_all(c, F.lit(STRONG_REFERENCE), F.lit(1)), F.regexp_extract_all(c, F.lit(WEAK_REFERENCE), F.lit(1)))
    none = F.array().cast("array<int>")

    def numbers(span: Column) -> Column:
        lows, highs = (F.regexp_extract_all(span, F.lit(NUMBER_RANGE), F.lit(i)) for i in (1, 2))

        def expand(lo: Column, hi: Column) -> Column:
            a, b = lo.cast("int"), hi.cast("int")
            return F.when((a <= b) & (b - a < WIDEST_RANGE), F.sequence(a, F.greatest(a, b))).otherwise(none)

        ranges = F.flatten(F.zip_with(lows, highs, expand))
        singles = F.transform(F.regexp_extract_all(F.regexp_replace(span, NUMBER_RANGE, " "), F.lit(r"(?U)(\d+)"), F.lit(1)), lambda d: d.cast("int"))
        return F.concat(ranges, singles)

    all_numbers = F.filter(F.flatten(F.transform(found, numbers)), lambda n: n.isNotNull())
    return F.coalesce(F.array_sort(F.array_distinct(all_numbers)), none)


def lexical_overlap(query: Column, doc: Column) -> Column:
    """Share of the query's distinct [a-z0-9]+ tokens that the document holds; 0 without tokens."""
    q, d = (F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))) for x in (query, doc))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, d)) / F.size(q)).otherwise(F.lit(0.0))


def feature_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(words(F.lower(c)), lambda w: F.length(w) > 2))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def seeded_hash(c: Column, seed: int) -> Column:
    """A number below 2^60 that depends on the text and the seed only, and that any engine with MD5 can recompute."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), c)), 1, 15), 16, 10).cast("bigint")


def hashing_embedding(c: Column, dimension: int = 32) -> Column:
    """A deterministic stand-in for an embedding model: SHA-256 bytes, repeated to the dimension, of length one."""
    digest = F.sha2(F.coalesce(c, F.lit("")), 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.conv(digest.substr((i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))
