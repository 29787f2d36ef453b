"""Exact cosine search of a set of query vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators.lexical import best_k, top_k

#: Query vectors held by a task at a time; a larger query set is taken in blocks.
QUERY_BLOCK = 4096


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def dense_search(records: DataFrame, queries: DataFrame, k: int, filters=None, key: str = "record_id", vector: str = "embedding", digits: int = 5) -> DataFrame:
    """(query_id, record_id, score, rank): the k most similar records of each query, scores rounded, ties by id.

    queries: (query_id, vector). Filters are applied before the search, so k results still come back. Vectors null, of
    another length, all zero or with NaN or infinities can't match, on either side. The queries are a stated set, broadcast in blocks of QUERY_BLOCK;
    each batch of records is one matrix product and hands on only its k best of each query.
    """
    if filters is not None:
        records = filters.apply(records)
    spark = records.sparkSession
    kind = records.schema[key].dataType.simpleString()
    qkind = queries.schema["query_id"].dataType.simpleString()
    rows = records.select(F.col(key).alias("record_id"), F.col(vector).alias("v")).where(F.col("record_id").isNotNull() & F.col("v").isNotNull())
    out, block = None, []

    def search(block: list) -> DataFrame:
        ids = [r.query_id for r in block]
        q = spark.sparkContext.broadcast((ids, _unit(np.array([r.vector for r in block], float))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, qs = q.value
            for batch in batches:
                vectors = batch.column(1)
                fits = np.flatnonzero(np.asarray(vectors.value_lengths()) == qs.shape[1])
                if not len(fits):
                    continue
                flat = vectors.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(fits), -1)  # nulls become NaN
                sound = np.isfinite(flat).all(axis=1) & (flat != 0).any(axis=1)
                kept, x = batch.take(pa.array(fits[sound])), _unit(flat[sound])
                if not len(x):
                    continue
                s = np.round(qs @ x.T, digits)
                i, j = best_k(s, k, kept.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(i)), kept.column(0).take(pa.array(j)), pa.array(s[i, j])], names=["query_id", "record_id", "score"])

        return rows.mapInArrow(run, f"query_id {qkind}, record_id {kind}, score double")

    usable = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("vector", lambda x: x != 0))
    for r in usable.toLocalIterator():
        if block and (len(block) == QUERY_BLOCK or len(block[-1].vector) != len(r.vector)):
            found = search(block)
            out = found if out is None else out.unionByName(found)
            block = []
        block.append(r)
    if block:
        found = search(block)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"query_id {qkind}, record_id {kind}, score double")
    return top_k(out, k)
