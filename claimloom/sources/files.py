"""Small file formats: synonym lists, evaluation sets, record and report sinks."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators.pooling import first_judgements


def read_synonyms(path: str) -> list[list[str]]:
    """Groups of a comma-separated synonym file (`a, b => c` counts as one group); comments and blanks are dropped, a missing file is empty."""
    if not os.path.exists(path):
        return []
    groups = []
    with open(path, encoding="utf-8") as f:
        for line in f:
            line = line.split("#", 1)[0].strip()
            group = [w.strip().lower() for w in line.replace("=>", ",").split(",") if w.strip()]
            if group:
                groups.append(group)
    return groups


def write_records(records: DataFrame, path: str) -> None:
    """JSON lines without null fields."""
    records.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def write_record_table(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by record type, so a filter on it prunes files; mode `ignore` keeps an existing index."""
    records.write.mode(mode).partitionBy("record_type").parquet(path)


def upsert_records(current: DataFrame, new: DataFrame, key: str = "record_id") -> DataFrame:
    """The new rows, and the current ones whose key isn't among them."""
    return current.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


_QUERY = "query_id string, text string, source_patent_id string, query_type string, qrels map<string,int>"


def write_eval_set(queries: DataFrame, notes: dict, path: str) -> None:
    """One text file: a line of notes, then a line a query. An evaluation set is read and written by people; it is small."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps({"_notes": notes}, ensure_ascii=False) + "\n")
        for row in queries.orderBy("query_id").select(F.to_json(F.struct(*queries.columns)).alias("j")).toLocalIterator():
            f.write(row.j + "\n")


def eval_set_lines(queries: DataFrame) -> DataFrame:
    """(value): a query a line, as the file holds them."""
    return queries.select(F.to_json(F.struct(*queries.columns)).alias("value"))


def read_eval_set(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return parse_eval_set(spark.read.text(path))


def parse_eval_set(lines: DataFrame) -> tuple[DataFrame, dict]:
    head = lines.where(F.col("value").startswith('{"_notes"')).limit(1).collect()
    body = lines.where((F.trim("value") != "") & ~F.col("value").startswith('{"_notes"'))
    return body.select(F.from_json("value", _QUERY).alias("q")).select("q.*"), json.loads(head[0].value)["_notes"] if head else {}


def write_report(report: DataFrame, path: str) -> None:
    """A report's rows, a few dozen, as one JSON list."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump([json.loads(r) for r in report.toJSON().collect()], f, ensure_ascii=False, indent=1)


def append_judgements(new: DataFrame, path: str) -> None:
    """Adds (query_id, record_id, grade) to a judgement cache of JSON lines, in the order of its additions."""
    new.select("query_id", "record_id", F.col("grade").cast("int").alias("grade"), F.lit(time.time_ns()).alias("seq")).write.mode("append").json(path)


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, record_id, grade) of a judgement cache: of each pair the first. One that isn't there is empty."""
    schema = "query_id string, record_id string, grade int, seq bigint"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "query_id string, record_id string, grade int")
    return first_judgements(spark.read.schema(schema).json(path))
