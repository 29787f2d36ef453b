"""Passages and search records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import normalize_paragraphs, normalize_text

TARGET_WORDS, MAX_WORDS, OVERLAP_PARAGRAPHS = 320, 500, 1
_CHUNK = "array<struct<start:int,end:int,text:string>>"


def chunk(paragraphs: list[str], target: int = TARGET_WORDS, most: int = MAX_WORDS, overlap: int = OVERLAP_PARAGRAPHS) -> list[tuple[int, int, str]]:
    """Greedy passages (first, last, text): closed at the target, before the most; an oversized paragraph stands alone."""
    sizes = [len(p.split()) for p in paragraphs]
    out, at = [], 0
    while at < len(sizes):
        end, total = at, 0
        while end < len(sizes) and total < target and (end == at or total + sizes[end] <= most):
            total += sizes[end]
            end += 1
        out.append((at, end - 1, " ".join(paragraphs[at:end])))
        if end == len(sizes):
            break
        at = max(end - overlap, at + 1)
    return out


def chunk_udf(target: int = TARGET_WORDS, most: int = MAX_WORDS, overlap: int = OVERLAP_PARAGRAPHS):
    @F.pandas_udf(_CHUNK)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda a: [dict(start=i, end=j, text=t) for i, j, t in chunk(list(a) if a is not None else [], target, most, overlap)])

    return run


def chunk_passages(df: DataFrame, key: str, paragraphs: str, target: int = TARGET_WORDS, most: int = MAX_WORDS, overlap: int = OVERLAP_PARAGRAPHS) -> DataFrame:
    """(key, start, end, text) of the passages of each row's paragraphs. Narrow: a document never leaves its task."""
    return df.select(key, F.explode(chunk_udf(target, most, overlap)(F.col(paragraphs))).alias("c")).select(key, "c.start", "c.end", "c.text")


def class_fields(code: str = "classification_raw") -> list:
    return [F.col(code).alias("classification_raw"), *[F.substring(code, 1, n).alias(f"classification_{name}") for name, n in (("section", 1), ("class", 3), ("subclass", 4))]]


def build_records(patents: DataFrame, claims: DataFrame) -> DataFrame:
    """Search records: summary, abstract, claims that aren't canceled, description passages.

    Title and abstract are normalised; both and the codes stand on every record.
    """
    base = patents.withColumns({"title": normalize_text(F.col("title")), "abstract": normalize_text(F.col("abstract"))}).select("patent_id", "title", "abstract", *class_fields(), "description_paragraphs")
    head = ["patent_id", "title", "abstract", "classification_raw", "classification_section", "classification_class", "classification_subclass"]

    def records(df: DataFrame, kind: str, suffix, text, **extra) -> DataFrame:
        more = {"claim_number": F.lit(None).cast("int"), "is_independent": F.lit(None).cast("boolean"), "paragraph_start": F.lit(None).cast("int"), "paragraph_end": F.lit(None).cast("int")} | extra
        return df.where(text != "").select(F.concat_ws(":", "patent_id", suffix).alias("record_id"), F.lit(kind).alias("record_type"), text.alias("text"), *head, *[c.alias(n) for n, c in more.items()])

    both = F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in ("title", "abstract")])
    own = base.select(*head)
    claimed = own.join(claims.where("status != 'canceled'").select("patent_id", "claim_number", "is_independent", F.col("text").alias("_text")), "patent_id")
    passages = base.select(*head, F.explode(chunk_udf()(normalize_paragraphs(F.col("description_paragraphs")))).alias("c"))
    return (
        records(own, "summary", F.lit("summary"), both)
        .unionByName(records(own, "abstract", F.lit("abstract"), F.col("abstract")))
        .unionByName(records(claimed, "claim", F.concat(F.lit("claim:"), F.col("claim_number")), F.col("_text"), claim_number=F.col("claim_number"), is_independent=F.col("is_independent")))
        .unionByName(records(passages, "description", F.format_string("description:%d-%d", "c.start", "c.end"), F.col("c.text"), paragraph_start=F.col("c.start"), paragraph_end=F.col("c.end")))
    )


def with_vectors(records: DataFrame, vectors: DataFrame, key: str = "record_id") -> DataFrame:
    """Records with the vector that a model made of them, null where it made none; of several of a record the least counts.

    vectors: (record_id, vector). A record without a vector is found by its words only.
    """
    one = vectors.where(F.col(key).isNotNull() & F.col("vector").isNotNull()).groupBy(key).agg(F.min("vector").alias("embedding"))
    return records.drop("embedding").join(one, key, "left")
