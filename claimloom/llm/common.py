"""Pieces the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.session import quoted

#: Unicode White_Space, as Java's (?U)\s has it; Python's \s also matches U+001C to U+001F, which are not white space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def counting_rows(patents: DataFrame, key: str = "patent_id", at: str = "ingested_at") -> DataFrame:
    """(key, at) of the row that counts for each key: the latest delivery.

    Only two narrow columns are read and pre-aggregated, so a key with a third of all rows costs one row per task.
    Null keys count for nothing; a key whose times are all null keeps a null time.
    """
    return (
        patents.select(quoted(key).alias("_key"), quoted(at).alias("_at"))
        .where(F.col("_key").isNotNull())
        .groupBy("_key")
        .agg(F.max("_at").alias("_at"))
    )


def in_chunks(batches: Iterator[pa.RecordBatch], text: str, most_chars: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that none holds much more text than given; a row is never cut."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not len(column):
            continue
        size, begin = 0, 0
        for i, n in enumerate(column.to_pylist()):
            size += len(n or "")
            if size >= most_chars:
                yield batch.slice(begin, i + 1 - begin)
                size, begin = 0, i + 1
        if begin < len(column):
            yield batch.slice(begin)
