"""The ingestion job table: idempotent enqueueing, leases, retries and summaries, as set operations on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENDING, COMPLETED, FAILED = "PENDING", "COMPLETED", "FAILED"
IN_FLIGHT = ["VALIDATING", "RECONSTRUCTING", "EMBEDDING", "INDEXING"]
MAX_RETRIES, LEASE_SECONDS, ERROR_CHARS = 3, 300.0, 2000

JOB = (
    "patent_id string, source_file string, source_hash string, status string, parser_version string, embedding_model string, "
    "record_count bigint, retry_count int, last_error string, worker_id string, leased_at double, updated_at double"
)


def same_content(incoming: str = "n", job: str = "j") -> Column:
    """Whether the content and the versions it was processed with are those of the job; null where there is none."""
    same = [F.col(f"{job}.{c}").eqNullSafe(F.col(f"{incoming}.{c}")) for c in ("source_hash", "parser_version", "embedding_model")]
    return F.col(f"{job}.status").isNotNull() & same[0] & same[1] & same[2]


def enqueue_decisions(jobs: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming (patent_id, source_file, source_hash, parser_version, embedding_model) with queue and retry_count.

    queue is false where nothing changed since the patent was completed, or since it failed for good. retry_count goes on
    where the same content is queued again, so that a patent that always fails comes to an end; changed content starts
    anew. Of several rows of a patent the one with the least hash counts.
    """
    own = ["source_file", "source_hash", "parser_version", "embedding_model"]
    n = incoming.where(F.coalesce("patent_id", F.lit("")) != "").groupBy("patent_id").agg(F.min_by(F.struct(*own), "source_hash").alias("r")).select("patent_id", "r.*")
    settled = F.coalesce(F.col("j.status").isin(COMPLETED, FAILED) & same_content(), F.lit(False))
    retries = F.when(same_content(), F.col("j.retry_count")).otherwise(0)
    return n.alias("n").join(jobs.alias("j"), "patent_id", "left").select("patent_id", *[F.col(f"n.{c}").alias(c) for c in own], (~settled).alias("queue"), F.coalesce(retries, F.lit(0)).alias("retry_count"))


def enqueued(decisions: DataFrame, now: float) -> DataFrame:
    """The PENDING rows of the decisions that queue."""
    return decisions.where("queue").select(
        "patent_id", "source_file", "source_hash", F.lit(PENDING).alias("status"), "parser_version", "embedding_model", F.lit(0).cast("long").alias("record_count"), F.col("retry_count").cast("int").alias("retry_count"),
        F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("string").alias("worker_id"), F.lit(None).cast("double").alias("leased_at"), F.lit(now).alias("updated_at"),
    )


def replaced(jobs: DataFrame, changed: DataFrame) -> DataFrame:
    """The table with the changed rows in place of their earlier state."""
    return jobs.join(changed.select("patent_id"), "patent_id", "left_anti").unionByName(changed)


def enqueue(jobs: DataFrame, incoming: DataFrame, now: float) -> DataFrame:
    """The table with every changed or new patent PENDING."""
    return replaced(jobs, enqueued(enqueue_decisions(jobs, incoming), now))


def requeue_failed(jobs: DataFrame, now: float) -> DataFrame:
    """The table with failed jobs PENDING and their retries anew, for use after what made them fail is mended."""
    return _change(jobs, F.col("status") == FAILED, status=F.lit(PENDING), retry_count=F.lit(0), updated_at=F.lit(now))


def _change(jobs: DataFrame, where: Column, **values: Column) -> DataFrame:
    return jobs.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def claimable(jobs: DataFrame, limit: int, max_retries: int = MAX_RETRIES) -> DataFrame:
    """The oldest pending jobs with retries left."""
    return jobs.where((F.col("status") == PENDING) & (F.col("retry_count") < max_retries)).orderBy("updated_at", "patent_id").limit(limit)


def leased(taken: DataFrame, worker: str, now: float) -> DataFrame:
    """The rows taken, as the worker holds them."""
    return taken.withColumns({"status": F.lit(IN_FLIGHT[0]), "worker_id": F.lit(worker), "leased_at": F.lit(now), "updated_at": F.lit(now)})


def claim(jobs: DataFrame, worker: str, limit: int, now: float, max_retries: int = MAX_RETRIES) -> DataFrame:
    """The table with up to limit jobs leased to the worker. A table has one writer at a time: the caller or the stream."""
    return replaced(jobs, leased(claimable(jobs, limit, max_retries), worker, now))


def advance(jobs: DataFrame, ids: list[str] | DataFrame, status: str, now: float) -> DataFrame:
    """The table with the jobs at a stage and their leases renewed. ids: a few, or a table with patent_id."""
    values = dict(status=F.lit(status), leased_at=F.lit(now), updated_at=F.lit(now))
    if isinstance(ids, DataFrame):
        marked = jobs.join(ids.select("patent_id", F.lit(True).alias("_mine")).distinct(), "patent_id", "left")
        return _change(marked, F.coalesce("_mine", F.lit(False)), **values).drop("_mine")
    return _change(jobs, F.col("patent_id").isin(ids), **values)


def apply_outcomes(jobs: DataFrame, outcomes: DataFrame, now: float, max_retries: int = MAX_RETRIES) -> DataFrame:
    """The table after a batch: outcomes (patent_id, record_count, error); a null error completes, another retries or fails."""
    o = outcomes.select("patent_id", F.col("record_count").cast("long").alias("_n"), F.col("error").alias("_e"), F.lit(True).alias("_o")).dropDuplicates(["patent_id"])
    j = jobs.join(o, "patent_id", "left")
    done, bad = F.col("_o").isNotNull() & F.col("_e").isNull(), F.col("_e").isNotNull()
    retries = F.col("retry_count") + 1
    out = j.withColumns({
        "status": F.when(done, COMPLETED).when(bad, F.when(retries < max_retries, PENDING).otherwise(FAILED)).otherwise(F.col("status")),
        "record_count": F.when(done, F.col("_n")).otherwise(F.col("record_count")),
        "last_error": F.when(bad, F.substring("_e", 1, ERROR_CHARS)).when(done, F.lit(None)).otherwise(F.col("last_error")),
        "retry_count": F.when(bad, retries).otherwise(F.col("retry_count")),
        "worker_id": F.when(F.col("_o").isNotNull(), F.lit(None)).otherwise(F.col("worker_id")),
        "leased_at": F.when(F.col("_o").isNotNull(), F.lit(None)).otherwise(F.col("leased_at")),
        "updated_at": F.when(F.col("_o").isNotNull(), F.lit(now)).otherwise(F.col("updated_at")),
    })
    return out.drop("_n", "_e", "_o")


def stale(jobs: DataFrame, now: float, lease: float = LEASE_SECONDS) -> DataFrame:
    return jobs.where(F.col("status").isin(IN_FLIGHT) & (F.col("leased_at") <= now - lease))


def reclaim_stale(jobs: DataFrame, now: float, lease: float = LEASE_SECONDS) -> DataFrame:
    """In-flight jobs whose lease ran out are pending again."""
    over = F.coalesce(F.col("status").isin(IN_FLIGHT) & (F.col("leased_at") <= now - lease), F.lit(False))
    return _change(jobs, over, status=F.lit(PENDING), worker_id=F.lit(None).cast("string"), leased_at=F.lit(None).cast("double"), updated_at=F.lit(now))


def get(jobs: DataFrame, patent_id: str) -> DataFrame:
    """The job of a patent; empty if there is none."""
    return jobs.where(F.col("patent_id") == patent_id)


def counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("jobs"))


def failures(jobs: DataFrame, limit: int = 20) -> DataFrame:
    return jobs.where(F.col("status") == FAILED).orderBy(F.desc("updated_at"), "patent_id").limit(limit).select("patent_id", "last_error", "retry_count", "updated_at")


def summary(jobs: DataFrame) -> DataFrame:
    done = F.count_if(F.col("status") == COMPLETED)
    return jobs.agg(
        F.count("*").alias("total"),
        done.alias("completed"),
        F.count_if(F.col("status") == FAILED).alias("failed"),
        F.coalesce(F.round(100.0 * done / F.count("*"), 1), F.lit(0.0)).alias("percent_complete"),
        F.coalesce(F.sum(F.when(F.col("status") == COMPLETED, F.col("record_count"))), F.lit(0)).alias("records_indexed"),
    )
