"""Problem 5: one ranking from several differently-scaled scores.

Method: reciprocal rank fusion. Each score gives places; the inverses of place plus a constant are summed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.session import materialise, quoted

#: A run with more rows than this is ranked in ranges of its values, not in one task.
RANGE_ROWS = 200_000
#: Names of so many large runs are broadcast at most; beyond, they are joined.
MOST_BROADCAST = 10_000


def places(values: DataFrame, group: list[str], value: str, ranges: int = 64) -> DataFrame:
    """(group, value, place, held): place of each distinct value, 1 + the rows with a smaller one; held: rows in the group.

    values: rows with the group columns, a double value and n, how many rows hold it (pre-aggregated here). The values of
    a group are cut into ranges at approximate quantiles; the rows of the ranges before are added to the places within.
    """
    per = values.groupBy(*group, value).agg(F.sum("n").alias("n"))
    edges = per.groupBy(*group).agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("_edges"))
    same = [F.col(f"p.{g}").eqNullSafe(F.col(f"h.{g}")) for g in group]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    ranged = per.alias("p").join(edges.alias("h"), cond).select(*[F.col(f"p.{g}").alias(g) for g in group], F.col(f"p.{value}").alias(value), F.col("p.n").alias("n"), F.size(F.filter("h._edges", lambda e: e < F.col(f"p.{value}"))).alias("_range"))
    totals = ranged.groupBy(*group, "_range").agg(F.sum("n").alias("_n"))  # at most `ranges` rows a group
    offsets = totals.select(
        *group,
        "_range",
        F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*group)).alias("held"),
    )
    w = Window.partitionBy(*group, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum("n").over(w), F.lit(0)))
    keys = [F.col(f"l.{g}").eqNullSafe(F.col(f"o.{g}")) for g in [*group, "_range"]]
    cond = keys[0]
    for s in keys[1:]:
        cond = cond & s
    return local.alias("l").join(offsets.alias("o"), cond).select(*[F.col(f"l.{g}").alias(g) for g in group], F.col(f"l.{value}").alias(value), (F.col("_before") + F.col("_local") + 1).alias("place"), "held")


def _ranges(most: int, range_rows: int) -> int:
    """Ranges that the values of the largest group are cut into: half of range_rows a range in the mean."""
    return min(max(2, math.ceil(2 * most / range_rows)), 1 << 14)


def _in_one_go(items: DataFrame, scores: list[str], constant: float) -> DataFrame:
    """The ranking of runs of bounded size: one exchange by run, everything else is sorting within its partitions."""
    run = Window.partitionBy("_run")
    place = {}
    for i, s in enumerate(scores):
        v = F.col(f"_v{i}")
        at = F.rank().over(run.orderBy(v.asc_nulls_last()))
        place[f"place_{s}"] = F.when(v.isNull(), F.count(v).over(run) + 1).otherwise(at).cast("bigint")
    wide = items.select("_run", "_item", *[c.alias(name) for name, c in place.items()])
    wide = wide.withColumn("place_sum", sum((F.col(n) for n in place), F.lit(0).cast("bigint"))).withColumn("fused", _fused(list(place), constant))
    return wide.withColumn("sum_place", F.rank().over(run.orderBy("place_sum")).cast("bigint")).withColumn("place", F.row_number().over(run.orderBy(F.desc("fused"), "_item")).cast("bigint"))


def _fused(places: list[str], constant: float) -> Column:
    # summed score by score, so that the order of the rows can't change the last bit
    return sum((1 / (F.lit(constant) + F.col(p)) for p in places), F.lit(0.0))


def _in_ranges(items: DataFrame, scores: list[str], constant: float, most: int, range_rows: int) -> DataFrame:
    """The ranking of runs of any size, by ranges of the values of each score."""
    ranges = _ranges(most, range_rows)
    pairs = F.array(*[F.struct(F.lit(i).alias("which"), F.col(f"_v{i}").alias("value")) for i in range(len(scores))])
    spread = items.select("_run", "_item", F.explode(pairs).alias("s")).select("_run", "_item", F.col("s.which").alias("which"), F.col("s.value").alias("value"))
    placed = places(spread.where("value IS NOT NULL").groupBy("_run", "which", "value").agg(F.count("*").alias("n")), ["_run", "which"], "value", ranges)
    have = placed.groupBy("_run", "which").agg(F.max("held").alias("held"))
    there = spread.where("value IS NOT NULL").join(placed.select("_run", "which", "value", "place"), ["_run", "which", "value"]).select("_run", "_item", "which", "place")
    missing = spread.where("value IS NULL").join(have, ["_run", "which"], "left").select("_run", "_item", "which", (F.coalesce(F.col("held"), F.lit(0)) + 1).alias("place"))
    names = [f"place_{s}" for s in scores]
    wide = there.unionByName(missing).groupBy("_run", "_item").agg(*[F.max(F.when(F.col("which") == i, F.col("place"))).alias(n) for i, n in enumerate(names)], F.sum("place").alias("place_sum"))
    wide = materialise(wide.withColumn("fused", _fused(names, constant)))
    one = F.lit(1).alias("n")
    sums = places(wide.select("_run", F.col("place_sum").cast("double").alias("value"), one), ["_run"], "value", ranges).select("_run", F.col("value").cast("long").alias("place_sum"), F.col("place").alias("sum_place"))
    order = places(wide.select("_run", (-F.col("fused")).alias("value"), one), ["_run"], "value", ranges).select("_run", (-F.col("value")).alias("fused"), F.col("place").alias("_tied"))
    ranked = wide.join(sums, ["_run", "place_sum"]).join(order, ["_run", "fused"])
    within = F.row_number().over(Window.partitionBy("_run", "_tied").orderBy("_item"))
    return ranked.select("_run", "_item", *names, "place_sum", "fused", "sum_place", (F.col("_tied") + within - 1).alias("place"))


def fused_ranking(df: DataFrame, run: str, item: str, higher: list[str], lower: list[str], constant: float = 60.0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(run, item, place_<score>..., place_sum, sum_place, fused, place): the items of each run in one order.

    Scores in `higher` are better when larger, in `lower` when smaller; a null, a NaN, or a rank below 1 in `lower` is
    missing, and its item's place is 1 + the items that have the score. Equal scores share a place, so no score counts
    by its range. fused is the sum of 1 / (constant + place); place orders the run by it, ties by the item. place_sum is
    the plain sum of the places, sum_place 1 + the items of the run with a lower one. Repeated rows of an item count
    once: where they differ, the best value of each score counts. Null runs and items are left out; extra columns are
    ignored.

    Runs of at most range_rows rows take one exchange; larger ones, told by a count of the rows of each run, are ranked
    in ranges of their values, as many as their rows ask for.
    """
    scores = [*higher, *lower]
    cleaned: list[Column] = []
    for s in scores:
        v = quoted(s).cast("double")
        fine = v.isNotNull() & ~F.isnan(v) & ((v >= 1) if s in lower else F.lit(True))
        cleaned.append(F.when(fine, v if s in lower else -v))
    rows = df.select(quoted(run).alias("_run"), quoted(item).alias("_item"), *[c.alias(f"_v{i}") for i, c in enumerate(cleaned)]).where("_run IS NOT NULL AND _item IS NOT NULL")
    best = [F.min(f"_v{i}").alias(f"_v{i}") for i in range(len(scores))]
    large = materialise(rows.groupBy("_run").agg(F.count("*").alias("_rows")).where(F.col("_rows") > range_rows))  # at most rows / range_rows runs
    number, most = large.agg(F.count("*"), F.max("_rows")).first()
    if not number:
        ranked = _in_one_go(rows.repartition("_run").groupBy("_run", "_item").agg(*best), scores, constant)
    else:
        names = F.broadcast(large.select("_run")) if number <= MOST_BROADCAST else large.select("_run")
        small = rows.join(names, "_run", "left_anti")
        ranked = _in_one_go(small.repartition("_run").groupBy("_run", "_item").agg(*best), scores, constant)
        ranked = ranked.unionByName(_in_ranges(rows.join(names, "_run", "left_semi").groupBy("_run", "_item").agg(*best), scores, constant, most, range_rows))
    return ranked.select(F.col("_run").alias(run), F.col("_item").alias(item), *[f"place_{s}" for s in scores], "place_sum", "sum_place", "fused", "place")
