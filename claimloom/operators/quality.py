"""Validation issues, corpus deduplication, quality report, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import is_blank

REQUIRED = ["title", "doc_number", "abstract", "detailed_description", "claims", "classification"]


def _found(raw: DataFrame) -> list[Column]:
    """For each thing that can be wrong with a record, a struct (field, issue, severity) or null."""
    hollow = lambda c: ~F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda x: ~is_blank(x))

    def issue(cond, field: str, text: str, severity: str):
        return F.when(cond, F.struct(F.lit(field).alias("field"), F.lit(text).alias("issue"), F.lit(severity).alias("severity")))

    found = [issue(~F.array_contains("present", f), f, "field absent", "error") for f in REQUIRED]
    found.append(issue(F.coalesce("doc_number", F.lit("")) == "", "doc_number", "missing or empty", "error"))
    found += [issue(is_blank(F.col(f)), f, "blank", "warning") for f in ("title", "abstract", "classification")]
    found.append(issue(hollow("claims"), "claims", "no non-blank claims", "error"))
    found.append(issue(hollow("detailed_description"), "detailed_description", "all paragraphs blank", "warning"))
    return found


def validate(raw: DataFrame) -> DataFrame:
    """(patent_id, field, issue, severity, file, position) of raw records.

    raw: the required fields as columns (text fields string, claims and detailed_description array<string>), present
    (array of the field names that the record had), file and position.
    """
    pid = F.when(F.coalesce("doc_number", F.lit("")) != "", F.col("doc_number")).otherwise("<unknown>")
    each = raw.select(pid.alias("patent_id"), "file", "position", F.explode(F.array_compact(F.array(*_found(raw)))).alias("i"))
    return each.select("patent_id", "i.field", "i.issue", "i.severity", "file", "position")


def without_errors(raw: DataFrame) -> DataFrame:
    """Raw records of which nothing is wrong but for warnings; what is wrong is seen in the record itself."""
    return raw.where(~F.exists(F.array_compact(F.array(*_found(raw))), lambda i: i["severity"] == "error"))


def duplicates(raw: DataFrame) -> DataFrame:
    """Later records of a number already seen in the corpus, whether or not the first was itself rejected."""
    w = Window.partitionBy("doc_number").orderBy("file", "position")
    seen = raw.where(F.coalesce("doc_number", F.lit("")) != "").select("doc_number", "file", "position", F.row_number().over(w).alias("n")).where("n > 1")
    return seen.select(F.col("doc_number").alias("patent_id"), F.lit("doc_number").alias("field"), F.lit("duplicate across corpus").alias("issue"), F.lit("error").alias("severity"), "file", "position")


def table_issues(patents: DataFrame) -> DataFrame:
    """(patent_id, field, issue, severity) of a typed patents table."""
    raw = patents.select(
        F.col("patent_id").alias("doc_number"), "title", "abstract", F.col("classification_raw").alias("classification"), F.col("claims_raw").alias("claims"), F.col("description_paragraphs").alias("detailed_description"),
        F.array(*[F.lit(f) for f in REQUIRED]).alias("present"), F.col("source_file").alias("file"), F.lit(0).alias("position"),
    )
    return validate(raw).select("patent_id", "field", "issue", "severity")


def quality_report(patents: DataFrame, issues: DataFrame) -> DataFrame:
    """(section, key, value): counts of patents, files, issues by severity and field, subclasses, list lengths."""
    total = patents.agg(
        F.count("*").alias("patents_loaded"),
        F.countDistinct("source_file").alias("source_files"),
        F.count_if(~F.col("has_description")).alias("patents_without_description"),
        F.coalesce(F.sum(F.when(F.col("claims_raw").isNotNull(), F.size("claims_raw"))), F.lit(0)).alias("claims_entries_total"),
        F.coalesce(F.sum(F.when(F.col("description_paragraphs").isNotNull(), F.size("description_paragraphs"))), F.lit(0)).alias("description_paragraphs_total"),
    )
    names = total.columns
    out = total.select(F.explode(F.array(*[F.struct(F.lit("corpus").alias("section"), F.lit(n).alias("key"), F.col(n).cast("long").alias("value")) for n in names])).alias("s")).select("s.*")
    for section, df, key in (("issues_by_severity", issues, F.col("severity")), ("issues_by_field", issues, F.col("field")), ("classification_subclasses", patents, F.substring("classification_raw", 1, 4))):
        out = out.unionByName(df.groupBy(key.alias("key")).agg(F.count("*").alias("value")).select(F.lit(section).alias("section"), "key", "value"))
    return out


def facet(df: DataFrame, column: str, size: int = 20) -> DataFrame:
    """The most frequent values with their counts, ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column).limit(size)


def corpus_stats(records: DataFrame) -> DataFrame:
    """One row: records, patents (approximate beyond small numbers), subclasses."""
    return records.agg(F.count("*").alias("records"), F.approx_count_distinct("patent_id", 0.01).alias("patents"), F.approx_count_distinct("classification_subclass", 0.01).alias("subclasses"))
