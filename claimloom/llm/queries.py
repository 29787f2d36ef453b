"""The queries of the training-data problems and, where SQL can express one, its SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import keyness, knn, leaks, mix, mojibake, neardup, oracle, rankfuse, split, splits
from claimloom.session import read_table

#: The vocabulary that sizes are counted with; any byte-level one in tiktoken's format will do.
TOKENIZER = os.environ.get("CLAIMLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split.oversized_paragraph_pieces(read_table(spark, d, "patents"))
    return pieces.where(F.col("piece_no") == 1).select("patent_id", "paragraph_no")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.oversized_paragraph_pieces(read_table(spark, d, "patents"))


def p1_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each paragraph come to: the paragraph itself, within the limit, with the overlap stated."""
    core = F.struct("piece_no", F.expr("substring(text, core_start - start + 1)").alias("core"))
    whole = F.concat_ws("", F.transform(F.array_sort(F.collect_list(core)), lambda c: c["core"]))
    return (
        p1_pieces(spark, d)
        .groupBy("patent_id", "paragraph_no")
        .agg(F.md5(whole).alias("digest"), F.sum(F.col("words") - F.col("overlap_words")).alias("words"), (F.max("words") <= 500).alias("fits"), (F.min(F.when(F.col("piece_no") > 0, F.col("overlap_words"))) == 50).alias("overlaps"))
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = knn.similar_pairs(read_table(spark, d, "search_records"), "record_id", "embedding", 10, 0.9)
    return pairs.select(F.col("a").alias("record_id_a"), F.col("b").alias("record_id_b"))


def _distinctive(spark: SparkSession, d: str, min_count: int) -> DataFrame:
    return keyness.distinctive_terms(read_table(spark, d, "search_records"), "record_id", "patent_id", ["title", "text"], min_count=min_count)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _distinctive(spark, d, 3).where("n >= 3 AND groups <= 3").select("record_id", "term")


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    return _distinctive(spark, d, 1).withColumn("z", F.round("z", 6))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.near_duplicate_pairs(neardup.patent_texts(read_table(spark, d, "patents")), "patent_id", "text", 3, 0.7)
    return pairs.select(F.col("key_a").alias("patent_id_a"), F.col("key_b").alias("patent_id_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_groups(neardup.patent_texts(read_table(spark, d, "patents")), "patent_id", "text")


def p5_ranking(spark: SparkSession, d: str) -> DataFrame:
    return rankfuse.fused_ranking(read_table(spark, d, "hits"), "run_id", "record_id", ["score", "rerank_score"], ["bm25_rank", "vector_rank"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_ranking(spark, d).where("sum_place <= 3").select("run_id", "record_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = splits.record_components(read_table(spark, d, "feature_rows"), "query_id", "patent_id")
    return found.where("linked").select(F.col("record").alias("query_id"), F.col("component").alias("group_id"))


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    return splits.grouped_splits(read_table(spark, d, "feature_rows"), "query_id", "patent_id", shares)


def p6_together(spark: SparkSession, d: str) -> DataFrame:
    """(component, rows, together): whether all rows of a component of queries came into one split."""
    rows = p6_splits(spark, d).where(splits.tidy("query_id").isNotNull())
    return rows.groupBy("component").agg(F.count("*").alias("rows"), (F.count_distinct("split") == 1).alias("together"))


def _leaks(spark: SparkSession, d: str, most_edits: int, long: tuple[int, int] | None = None) -> DataFrame:
    return leaks.leaks(read_table(spark, d, "documents"), "doc_id", "text", read_table(spark, d, "eval_passages"), "item_id", "text", most_edits=most_edits, long=long)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d, 1).where("edits = 0 AND window = 12").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d, 1, (40, 8))


def _mixture(spark: SparkSession, d: str, sizes=None) -> mix.Mixture:
    return mix.Mixture(read_table(spark, d, "documents"), "source", "text", "doc_id", read_table(spark, d, "source_weights"), sizes=sizes)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).report().where("short").select("source")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d, mix.tokenizer_sizes(TOKENIZER)).report()


def p8_plan(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d, mix.tokenizer_sizes(TOKENIZER)).plan("doc_id")


def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    """The listed sources with their sizes and targets in words, and whether the plan keeps to max_repeats."""
    mixed = _mixture(spark, d)
    taken = mixed.plan("doc_id").where("source IS NOT NULL").groupBy("source").agg(F.max("copies").alias("most"))
    rows = mixed.report().select("source", "documents", "size", "max_repeats", F.round("target_share", 9).alias("target_share"), F.round("target_size", 3).alias("target_size"))
    return rows.join(taken, "source", "left").select(*rows.columns, F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True)).alias("kept"))


def p9_mended(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.mend_encoding(read_table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_mended(spark, d).select("doc_id").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p1_rebuilt": p1_rebuilt,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_scores": p3_scores,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_ranking": p5_ranking,
    "p6_found": p6_found,
    "p6_splits": p6_splits,
    "p6_together": p6_together,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p8_found": p8_found,
    "p8_shares": p8_shares,
    "p8_plan": p8_plan,
    "p8_sources": p8_sources,
    "p9_found": p9_found,
    "p9_mended": p9_mended,
}

SQL = oracle.SQL
