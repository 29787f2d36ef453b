"""Raw corpus files: JSON arrays of records, read without trusting their shape."""

from __future__ import annotations

import glob
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators.quality import duplicates, validate, without_errors

PATTERN = "patents_*.json"
_FIELDS = ["title", "doc_number", "abstract", "classification", "filename", "bibtex"]
_LISTS = ["claims", "detailed_description"]


class CorpusError(ValueError):
    """The corpus can't be read as a whole."""


def corpus_dir(candidates: list[str], variable: str = "CLAIMLOOM_CORPUS") -> str:
    """The directory named by the environment, else the first candidate with a corpus file."""
    if named := os.environ.get(variable):
        return named
    for d in candidates:
        if glob.glob(os.path.join(d, PATTERN)):
            return d
    raise CorpusError(f"no {PATTERN} in {candidates}")


def read_env(path: str) -> None:
    """Sets variables from KEY=value lines, without overwriting any that are set."""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in map(str.strip, f):
                if line and not line.startswith("#") and "=" in line:
                    key, value = line.split("=", 1)
                    os.environ.setdefault(key.strip(), value.strip().strip("\"'"))


def _scalar(field: str) -> Column:
    """A field as text, whatever its JSON type; missing and JSON null give null."""
    return F.try_variant_get(F.col("v"), f"$.{field}", "string")


def _list(field: str) -> Column:
    """A field as array<string>: missing, null and '' give an empty one, a text one element, nulls in a list are dropped."""
    kind = F.coalesce(F.schema_of_variant(F.variant_get(F.col("v"), f"$.{field}", "variant")), F.lit("VOID"))
    elements = F.transform(F.try_variant_get(F.col("v"), f"$.{field}", "array<variant>"), lambda x: F.try_variant_get(x, "$", "string"))
    none = F.array().cast("array<string>")
    one = F.when(F.coalesce(_scalar(field), F.lit("")) != "", F.array(_scalar(field))).otherwise(none)
    return F.when(kind.startswith("ARRAY"), F.array_compact(elements)).when(kind == "VOID", none).otherwise(one)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): the corpus files, whole, as one malformed element must not void the others. No file raises CorpusError."""
    if "://" not in path and not glob.glob(os.path.join(path, PATTERN)):
        raise CorpusError(f"no {PATTERN} files in {path}")
    if "://" in path:
        make = spark._jvm.org.apache.hadoop.fs.Path
        where = make(f"{path.rstrip('/')}/{PATTERN}")
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where):
            raise CorpusError(f"no {PATTERN} files in {path}")
    return spark.read.text(f"{path.rstrip('/')}/{PATTERN}", wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")


def parse_files(files: DataFrame) -> DataFrame:
    """One row a record object: its fields, which of them were present, file and position.

    A file that isn't a JSON array raises CorpusError with its name. Elements that aren't objects are skipped.
    """
    files = files.select("file", F.expr("try_parse_json(value)").alias("doc"))
    bad = files.where(F.col("doc").isNull() | ~F.coalesce(F.schema_of_variant("doc"), F.lit("")).startswith("ARRAY")).select("file", F.schema_of_variant("doc").alias("kind")).limit(1).collect()
    if bad:
        raise CorpusError(f"{bad[0].file}: " + (f"expected a list, found {bad[0].kind}" if bad[0].kind else "not valid JSON"))
    each = files.select("file", F.posexplode(F.variant_get(F.col("doc"), "$", "array<variant>")).alias("position", "v"))
    objects = each.where(F.schema_of_variant("v").startswith("OBJECT"))
    present = F.array_compact(F.array(*[F.when(F.try_variant_get(F.col("v"), f"$.{f}", "variant").isNotNull(), F.lit(f)) for f in [*_FIELDS, *_LISTS]]))
    return objects.select("file", "position", *[_scalar(f).alias(f) for f in _FIELDS], *[_list(f).alias(f) for f in _LISTS], present.alias("present"), F.to_json("v").alias("source_json"))


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    return parse_files(read_files(spark, path))


def load_corpus(spark: SparkSession, path: str, skip_errors: bool = True) -> tuple[DataFrame, DataFrame]:
    """(patents, issues) of a corpus; records with an error are left out of patents if skip_errors."""
    return typed_corpus(raw_records(spark, path), skip_errors)


def typed_corpus(raw: DataFrame, skip_errors: bool = True) -> tuple[DataFrame, DataFrame]:
    """(patents, issues) of raw records. A record's own issues are found in the pass that reads it; only numbers are shuffled, for the duplicates."""
    again = duplicates(raw)
    issues = validate(raw).unionByName(again)
    kept = raw
    if skip_errors:
        kept = without_errors(raw).join(again.select("file", "position"), ["file", "position"], "left_anti")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    patents = kept.select(
        F.col("doc_number").alias("patent_id"), text("title").alias("title"), text("abstract").alias("abstract"), text("classification").alias("classification_raw"), F.col("claims").alias("claims_raw"),
        F.col("detailed_description").alias("description_paragraphs"), text("bibtex").alias("bibtex"), F.col("file").alias("source_file"), text("filename").alias("filename"),
        F.exists("detailed_description", lambda p: p.rlike(r"(?U)[^\s\p{Cf}]")).alias("has_description"), F.sha2("source_json", 256).alias("source_hash"),
    )
    return patents, issues
