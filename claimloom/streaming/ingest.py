"""Streaming: continuous ingestion of corpus rows, and job states folded from an event stream."""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import jobs as J
from claimloom.operators.claims import latest_rows, reconstruct_claims
from claimloom.operators.quality import table_issues
from claimloom.operators.records import build_records
from claimloom.session import materialise


class Versions:
    """Directories on shared storage that become current once their write has committed; there is one writer."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self):
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        return make, make(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        """Those that Spark marked as complete, oldest first."""
        make, fs = self._fs()
        if not fs.exists(make(self.path)):
            return []
        found = sorted(s.getPath().getName() for s in fs.listStatus(make(self.path)))
        return [n for n in found if fs.exists(make(f"{self.path}/{n}/_SUCCESS"))]

    def remove(self, names: list[str]) -> None:
        make, fs = self._fs()
        for n in names:
            fs.delete(make(f"{self.path}/{n}"), True)


class JobTable(Versions):
    """A job table: whole versions, and after each the changes since, which hold changed rows only.

    Readers see the latest whole version with its committed changes. After COMPACT changes the next one writes a whole
    version and removes the ones before the last, which readers may still hold.
    """

    COMPACT = 50

    def _current(self) -> list[str]:
        names = self.names()
        whole = [i for i, n in enumerate(names) if n.endswith("-all")]
        return names[whole[-1] if whole else 0 :]

    def read(self) -> DataFrame:
        names = self._current()
        if not names:
            return self.spark.createDataFrame([], J.JOB)
        rows = self.spark.read.schema(J.JOB).parquet(*[f"{self.path}/{n}" for n in names])
        if len(names) == 1:
            return rows
        # names sort in the order of writing
        version = F.regexp_extract(F.col("_metadata.file_path"), r"/(v\d+-\w+)/[^/]*$", 1)
        columns = rows.columns
        return rows.select(*columns, version.alias("_v")).groupBy("patent_id").agg(F.max_by(F.struct(*columns), "_v").alias("r")).select("r.*")

    def write(self, jobs: DataFrame) -> None:
        """A whole version."""
        before = self._current()
        jobs.write.parquet(f"{self.path}/v{time.time_ns():020d}-all")
        self.remove([n for n in self.names() if n < (before or [""])[0]])

    def update(self, changed: DataFrame) -> None:
        """Changed or new rows."""
        if len(self._current()) > self.COMPACT:
            self.write(J.replaced(self.read(), changed))
        else:
            changed.write.parquet(f"{self.path}/v{time.time_ns():020d}-part")


class RecordTable(Versions):
    """Search records by the batch that made them. A batch only adds; of each patent the records of its latest batch count."""

    def append(self, records: DataFrame) -> None:
        """Adds a batch; batches are numbered by the time they were made, so what a replay makes again is the latest."""
        records.write.partitionBy("record_type").parquet(f"{self.path}/batch={time.time_ns():020d}")

    def read(self) -> DataFrame:
        rows = self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/{n}" for n in self.names()])
        latest = rows.groupBy("patent_id").agg(F.max("batch").alias("batch"))
        return rows.join(latest, ["patent_id", "batch"], "left_semi").drop("batch")


def patents_hash(patents: DataFrame) -> DataFrame:
    """(patent_id, source_file, source_hash) of typed rows: a hash of their canonical JSON."""
    body = F.to_json(F.struct("title", "abstract", "classification_raw", "claims_raw", "description_paragraphs", "bibtex", "filename"))
    return patents.select("patent_id", "source_file", F.sha2(body, 256).alias("source_hash"))


@dataclass
class WorkerResult:
    """Jobs taken, completed and given up, and records made."""

    processed: int = 0
    completed: int = 0
    failed: int = 0
    records: int = 0


def drain(patents: DataFrame, table: JobTable, sink: Callable[[DataFrame], None], worker: str = "worker", batch: int = 100_000, max_batches: int | None = None, max_retries: int = J.MAX_RETRIES, embed: Callable | None = None) -> WorkerResult:
    """Takes up pending jobs in batches until none is left, through all stages; patents holds one row for each.

    A job is leased when it is taken and its lease renewed at each stage. What is wrong with a patent (not found, invalid,
    no records) is its own error and is tried again max_retries times in all; a failure of a batch as a whole is recorded
    for all its jobs and raised.
    """
    result = WorkerResult()
    while max_batches is None or max_batches > 0:
        max_batches = None if max_batches is None else max_batches - 1
        taken = materialise(J.leased(J.claimable(table.read(), batch, max_retries), worker, time.time()))
        number = taken.count()
        if not number:
            break
        table.update(taken)
        ids = taken.select("patent_id")
        try:
            work = patents.join(ids, "patent_id", "left_semi")
            wrong = materialise(table_issues(work).where("severity = 'error'").groupBy("patent_id").agg(F.array_join(F.array_sort(F.collect_list("issue")), ", ").alias("issues")))
            table.update(J.advance(taken, ids, "RECONSTRUCTING", time.time()))
            sound = work.join(wrong, "patent_id", "left_anti")
            made = build_records(sound, reconstruct_claims(sound))
            if embed is not None:
                table.update(J.advance(taken, ids, "EMBEDDING", time.time()))
                made = made.withColumn("embedding", embed(F.col("text")))
            records = materialise(made)
            table.update(J.advance(taken, ids, "INDEXING", time.time()))
            sink(records)
            per = records.groupBy("patent_id").agg(F.count("*").alias("record_count"))
            there = work.select("patent_id", F.lit(True).alias("there")).distinct()
            outcome = ids.join(there, "patent_id", "left").join(wrong, "patent_id", "left").join(per, "patent_id", "left")
            error = F.when(F.col("there").isNull(), "ValueError: not found in the source").when(F.col("issues").isNotNull(), F.concat(F.lit("ValueError: validation failed: "), "issues")).when(F.col("record_count").isNull(), "ValueError: no records")
            after = materialise(J.apply_outcomes(taken, outcome.select("patent_id", F.coalesce("record_count", F.lit(0)).alias("record_count"), error.alias("error")), time.time(), max_retries))
            table.update(after)
        except Exception as e:
            text = f"{type(e).__name__}: {e}\n{traceback.format_exc(limit=3)}"[: J.ERROR_CHARS]
            table.update(J.apply_outcomes(taken, ids.select("patent_id", F.lit(0).alias("record_count"), F.lit(text).alias("error")), time.time(), max_retries))
            raise
        done = {r.status: r for r in after.groupBy("status").agg(F.count("*").alias("n"), F.sum("record_count").alias("r")).collect()}
        result.processed += number
        result.completed += done[J.COMPLETED].n if J.COMPLETED in done else 0
        result.failed += done[J.FAILED].n if J.FAILED in done else 0
        result.records += done[J.COMPLETED].r if J.COMPLETED in done else 0
    return result


def ingest_batch(patents: DataFrame, table: JobTable, sink: Callable[[DataFrame], None], parser_version: str, embedding_model: str | None = None, **how) -> tuple[int, int]:
    """Ingests the new and changed patents of a batch: (queued, skipped). Running it again queues nothing.

    Of several deliveries of a patent the latest counts, for its hash as for its records.
    """
    latest = materialise(latest_rows(patents) if "ingested_at" in patents.columns else patents.dropDuplicates(["patent_id"]))
    incoming = patents_hash(latest).withColumns({"parser_version": F.lit(parser_version), "embedding_model": F.lit(embedding_model).cast("string")})
    decided = materialise(J.enqueue_decisions(table.read(), incoming))
    queued, every = decided.where("queue").count(), decided.count()
    if queued:
        table.update(J.enqueued(decided, time.time()))
        drain(latest, table, sink, **how)
    return queued, every - queued


def ingest_stream(spark: SparkSession, source: str, schema, table_path: str, records_path: str, checkpoint: str, parser_version: str, once: bool = True):
    """A stream of patents parquet files into the record table; the job table makes replays harmless."""
    table, records = JobTable(spark, table_path), RecordTable(spark, records_path)

    def batch(df: DataFrame, _: int) -> None:
        ingest_batch(df, table, records.append, parser_version)

    writer = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_counts(events: DataFrame, time_column: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling counts by event type; rows later than `late` are dropped. Works on streams and on tables."""
    watermarked = events.withColumn(time_column, F.col(time_column).cast("timestamp")).withWatermark(time_column, late) if events.isStreaming else events
    return watermarked.groupBy(F.window(time_column, window).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def latest_hits(hits: DataFrame, late: str = "1 day") -> DataFrame:
    """Hits with repeats (same run and record) dropped; on a stream within the watermark."""
    if hits.isStreaming:
        return hits.withWatermark("logged_at", late).dropDuplicatesWithinWatermark(["run_id", "record_id"])
    return hits.dropDuplicates(["run_id", "record_id"])
