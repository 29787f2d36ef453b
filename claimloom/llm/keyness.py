"""Problem 3: how distinctive a term is for a record.

Method: log-odds ratio of the record against the rest of the collection, with an informative Dirichlet prior taken from
the collection's counts, divided by its standard error (a z-score).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.session import materialise, quoted

_TERM = regex.compile(r"\p{L}+")
#: A task hands over its collection counts when it holds so many terms.
FLUSH = 200_000
#: Terms with more than this share of all tokens are broadcast; there can't be more than its inverse of them.
HEAVY_SHARE = 1 / 20_000
#: Hashes of repeated rows that are broadcast; more are joined.
MOST_BROADCAST = 1_000_000


def _count(batches: Iterator[pa.RecordBatch], min_letters: int, min_count: int, most_groups: int) -> Iterator[pa.RecordBatch]:
    """One pass over the texts: the records' terms (kind 0) and the task's part of the collection's counts (kind 1).

    The groups of a term are told apart up to most_groups + 1 of them, which is all the collection needs to know.
    """
    totals: Counter[str] = Counter()
    groups: dict[str, set[str]] = {}
    names = ["kind", "id", "group", "tokens", "term", "n", "groups"]
    groups_type = pa.list_(pa.string())

    def flush() -> pa.RecordBatch:
        k = len(totals)
        out = pa.RecordBatch.from_arrays(
            [pa.array([1] * k, pa.int8()), pa.nulls(k, pa.string()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()), pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64()), pa.array([sorted(groups.get(t, ())) for t in totals], groups_type)],
            names=names,
        )
        totals.clear()
        groups.clear()
        return out

    for batch in batches:
        ids, owners, terms, ns, sizes = [], [], [], [], []

        def given() -> pa.RecordBatch:
            k = len(ids)
            return pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int8()), pa.array(ids, pa.string()), pa.array(owners, pa.string()), pa.array(sizes, pa.int64()), pa.array(terms, pa.string()), pa.array(ns, pa.int64()), pa.nulls(k, groups_type)], names=names)

        for key, group, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            found = Counter(t for t in _TERM.findall(text.lower()) if len(t) >= min_letters)
            size = found.total()
            for t, n in found.items():
                totals[t] += n
                if group is not None:
                    own = groups.get(t)
                    if own is None:
                        groups[t] = {group}
                    elif len(own) <= most_groups:
                        own.add(group)
                if n >= min_count:
                    ids.append(key)
                    owners.append(group)
                    terms.append(t)
                    ns.append(n)
                    sizes.append(size)
            if len(totals) > FLUSH:
                yield flush()
            if len(ids) > 100_000:
                yield given()
                ids, owners, terms, ns, sizes = [], [], [], [], []
        if ids:
            yield given()
    if totals:
        yield flush()


def unrepeated(rows: DataFrame) -> DataFrame:
    """The distinct rows. Only those whose hash occurs more than once are shuffled with their texts."""
    hashed = rows.withColumn("_h", F.xxhash64(*rows.columns))
    again = materialise(hashed.groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1").select("_h"))
    number = again.count()
    if not number:
        return rows
    again = F.broadcast(again) if number <= MOST_BROADCAST else again
    once = hashed.join(again, "_h", "left_anti").drop("_h")
    return once.unionByName(hashed.join(again, "_h", "left_semi").drop("_h").distinct())


def distinctive_terms(df: DataFrame, key: str, group: str, texts: list[str], min_letters: int = 3, min_count: int = 1, most_groups: int = 3, prior: float = 1000.0) -> DataFrame:
    """(key, term, n, collection_n, groups, z): every term of every record with how characteristic it is of the record.

    A term is a maximal run of Unicode letters of the lower-cased texts (nulls left out, joined by one blank). n counts
    it in the record, collection_n in all records, groups the distinct values of `group` whose records hold it, told
    apart up to most_groups + 1 (null groups don't count). z is the log-odds ratio of record against rest over its
    standard error, under a Dirichlet prior of `prior` tokens spread as in the collection; null where the collection
    holds nothing else. Only terms at least min_count times in the record are given; the collection's counts are over
    all records and terms. Rows equal in key, group and texts count once; empty texts and null keys have no rows but
    texts of null keys count in the collection. Extra columns are ignored.
    """
    joined = F.concat_ws(" ", *[quoted(t).cast("string") for t in texts])
    base = unrepeated(df.select(quoted(key).cast("string").alias("id"), quoted(group).cast("string").alias("group"), joined.alias("text")))
    schema = "kind tinyint, id string, group string, tokens bigint, term string, n bigint, groups array<string>"
    counted = materialise(base.mapInArrow(lambda it: _count(it, min_letters, min_count, most_groups), schema))

    partial = counted.where("kind = 1")
    salted = partial.groupBy("term", F.spark_partition_id().alias("_s") % 16).agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("groups")))), 1, most_groups + 1).alias("groups"))
    stats = salted.groupBy("term").agg(
        F.sum("n").alias("collection_n"),
        F.least(F.lit(most_groups + 1), F.size(F.array_distinct(F.flatten(F.collect_list("groups"))))).alias("groups"),
    )
    total = counted.where("kind = 1").agg(F.sum("n")).first()[0] or 0
    records = counted.where("kind = 0 AND id IS NOT NULL").select("id", "tokens", "term", "n")

    heavy = stats.where(F.col("collection_n") > max(total * HEAVY_SHARE, 50))
    marked = records.join(F.broadcast(heavy), "term", "left")
    frequent = marked.where(F.col("collection_n").isNotNull())
    rest = marked.where(F.col("collection_n").isNull()).drop("collection_n", "groups").join(stats, "term")
    scored = frequent.unionByName(rest)

    n, tokens, c, all_n = (x.cast("double") for x in (F.col("n"), F.col("tokens"), F.col("collection_n"), F.lit(total)))
    a = prior * c / all_n
    own, others = tokens + prior - n - a, (all_n - tokens) + prior - (c - n) - a
    odds = F.log((n + a) / own) - F.log((c - n + a) / others)
    z = F.when((own > 0) & (others > 0), odds / F.sqrt(1 / (n + a) + 1 / (c - n + a)))
    return scored.select(F.col("id").alias(key), "term", "n", "collection_n", "groups", z.alias("z"))
