"""Known-item test collections from the corpus' own structure, and their statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import lexical_overlap, seeded_hash


def build_eval_set(records: DataFrame, n_queries: int = 60, seed: int = 13, min_records: int = 2) -> DataFrame:
    """(query_id, text, source_patent_id, query_type, qrels): two queries a patent, drawn by a seeded hash.

    An `a` query is the abstract (its own abstract and summary aren't relevant), a `c` query an independent claim of the
    patent (itself not relevant). Grades: independent claim 3, other claims, abstract and summary 2, descriptions 1.
    """
    rows = records.dropDuplicates(["record_id"])
    grade = F.when(F.col("record_type") == "claim", F.when(F.col("is_independent"), 3).otherwise(2)).when(F.col("record_type").isin("abstract", "summary"), 2).otherwise(1)
    per = rows.groupBy("patent_id").agg(F.count("*").alias("n"), F.max("abstract").alias("abstract"))
    eligible = per.where((F.col("n") >= min_records) & (F.coalesce("abstract", F.lit("")) != ""))
    drawn = seeded_hash(F.col("patent_id"), seed)
    chosen = eligible.orderBy(drawn, "patent_id").limit(n_queries)
    chosen = chosen.withColumn("no", F.row_number().over(Window.orderBy(drawn, "patent_id")) - 1)  # n_queries rows
    graded = rows.join(F.broadcast(chosen.select("patent_id", "no")), "patent_id").select("patent_id", "no", "record_id", "record_type", "text", "is_independent", grade.alias("grade"))
    claim = graded.where("is_independent").groupBy("patent_id", "no").agg(F.min_by(F.struct("record_id", "text"), F.struct(seeded_hash(F.col("record_id"), seed), "record_id")).alias("c"))
    queries = chosen.select("patent_id", F.format_string("q%03da", "no").alias("query_id"), F.col("abstract").alias("text"), F.lit("abstract_to_claim").alias("query_type"), F.lit(None).cast("string").alias("own"))
    queries = queries.unionByName(claim.select("patent_id", F.format_string("q%03dc", "no").alias("query_id"), F.col("c.text").alias("text"), F.lit("claim_to_patent").alias("query_type"), F.col("c.record_id").alias("own")))
    relevant = queries.join(graded.select("patent_id", "record_id", "record_type", "grade"), "patent_id").where(
        F.when(F.col("query_type") == "abstract_to_claim", ~F.col("record_type").isin("abstract", "summary")).otherwise(F.col("record_id") != F.col("own"))
    )
    return relevant.groupBy("query_id", "text", F.col("patent_id").alias("source_patent_id"), "query_type").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("record_id", "grade")))).alias("qrels"))


def overlap_report(eval_queries: DataFrame, records: DataFrame) -> DataFrame:
    """One row: how many words queries share with their first graded record (by id) that exists: n, mean, median."""
    first = eval_queries.select("query_id", F.col("text").alias("query"), F.explode("qrels").alias("record_id", "grade"))
    texts = records.select("record_id", "text").dropDuplicates(["record_id"])
    found = first.join(texts, "record_id").groupBy("query_id").agg(F.min_by(F.struct("query", "text"), "record_id").alias("d"))
    overlaps = found.select(lexical_overlap(F.col("d.query"), F.col("d.text")).alias("o"))
    return overlaps.agg(F.count("*").alias("n"), F.round(F.avg("o"), 4).alias("mean_overlap"), F.round(F.median("o"), 4).alias("median_overlap"))


def cross_patent(eval_queries: DataFrame) -> DataFrame:
    """One row: graded pairs, those outside the query's own patent, and pairs by grade."""
    e = eval_queries.select("source_patent_id", F.explode("qrels").alias("record_id", "grade"))
    own = F.col("source_patent_id").isNotNull() & F.col("record_id").startswith(F.concat("source_patent_id", F.lit(":")))
    return e.agg(F.count("*").alias("pairs"), F.count_if(~own).alias("cross_patent"), *[F.count_if(F.col("grade") == g).alias(f"grade_{g}") for g in (1, 2, 3)])


def paraphrase(eval_queries: DataFrame, rewrite: Callable[[str], str | None]) -> DataFrame:
    """Queries with rewritten texts, qrels kept; queries whose rewriting fails or is blank are dropped."""

    def safe(t: str) -> str | None:
        try:
            return rewrite(t)
        except Exception:
            return None

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else safe(t))

    return eval_queries.withColumn("text", run("text")).where(F.trim(F.coalesce("text", F.lit(""))) != "")
