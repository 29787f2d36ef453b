"""Problem 6: splits that keep related records together.

Method: connected components by alternating large-star and small-star over the records' shared entities, then a hash of
the component's name into ranges in the proportions wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from claimloom.session import materialise, quoted


def tidy(column: str):
    """An id without blanks around it, in lower case; null where nothing is left."""
    c = F.lower(F.trim(quoted(column).cast("string")))
    return F.when(c != "", c)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs the larger (large) or the smaller (small) neighbours of each node on the least of its neighbourhood.

    The least is pre-aggregated before the shuffle and joined back, so the neighbours of a hub never meet in one task
    as a list; the adaptive skew join splits the hub's edges.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; the component is its least node. edges: (u, v), same type.

    Rounds go on until the stars have settled; their number grows with the logarithm of the longest chain.
    """
    now = edges.select("u", "v").where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    now = materialise(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        now = materialise(_star(_star(now, True), False))
        # equal count and hash sum: the same set of edges, so the stars have settled
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (seen[0], seen[1]) == mark:
            break
        mark = (seen[0], seen[1])
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def record_components(df: DataFrame, record: str, entity: str) -> DataFrame:
    """(record, component, linked): the component of each distinct tidied record id; linked: it shares it with another.

    Two records are linked if a row of each holds the same tidied entity; null and blank entities link nothing, null and
    blank records are left out. component is the least record of those linked.
    """
    pairs = df.select(tidy(record).alias("r"), tidy(entity).alias("e")).where(F.col("r").isNotNull()).distinct()
    # an entity's node sorts after every record's, so the least node of a component is its least record
    edges = pairs.where(F.col("e").isNotNull()).select(F.concat(F.lit("0"), "r").alias("u"), F.concat(F.lit("1"), "e").alias("v"))
    found = connected_components(edges).where(F.col("node").startswith("0"))
    found = found.select(F.expr("substring(node, 2)").alias("r"), F.expr("substring(component, 2)").alias("component"))
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    known = found.join(sizes, "component")
    return pairs.select("r").distinct().join(known, "r", "left").select(F.col("r").alias("record"), F.coalesce("component", "r").alias("component"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("linked"))


def grouped_splits(df: DataFrame, record: str, entity: str, shares: dict[str, float], seed: int = 7) -> DataFrame:
    """The rows of df with their component and split; rows linked through record or entity, also in chains, share both.

    A split is the range of [0, 1) that the component's hash falls into; shares need not add up to 1. Rows with a null
    or blank record are their own components by their entity, or by all their columns if that is null too. Columns
    named component or split are replaced.
    """
    total = float(sum(shares.values()))
    if total <= 0 or min(shares.values()) < 0:
        raise ValueError("shares must be at least 0 and not all 0")
    comp = record_components(df, record, entity).select(F.col("record").alias("_cl_r"), F.col("component").alias("_cl_c"))
    plain = [f.name for f in df.schema.fields if f.name not in ("component", "split", "_cl_r", "_cl_e", "_cl_c")]
    rows = df.select(*[quoted(c) for c in plain], tidy(record).alias("_cl_r"), tidy(entity).alias("_cl_e"))
    # rows without a record hang on their entity's component, if any record has the entity; the others need no such join
    of_entity = rows.where("_cl_r IS NOT NULL AND _cl_e IS NOT NULL").groupBy("_cl_e").agg(F.min("_cl_r").alias("_cl_r"))
    lone = rows.where("_cl_r IS NULL AND _cl_e IS NOT NULL").drop("_cl_r").join(of_entity, "_cl_e", "left")
    bare = rows.where("_cl_r IS NULL AND _cl_e IS NULL")
    placed = rows.where("_cl_r IS NOT NULL").unionByName(lone).join(comp, "_cl_r", "left").unionByName(bare.withColumn("_cl_c", F.lit(None).cast("string")))
    content = F.xxhash64(*[quoted(c) for c in plain if not isinstance(df.schema[c].dataType, MapType)]).cast("string")
    name = F.coalesce("_cl_c", F.concat(F.lit("entity:"), "_cl_e"), F.concat(F.lit("row:"), content))
    at = F.pmod(F.xxhash64(name, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    split, edge = None, 0.0
    for label, share in shares.items():
        edge += share / total
        split = F.when(at < edge, label) if split is None else split.when(at < edge, label)
    return placed.select(*[quoted(c) for c in plain], name.alias("component"), split.otherwise(list(shares)[-1]).alias("split"))


def reached_shares(splits: DataFrame) -> DataFrame:
    """(split, rows, components, share): what the splits came to; a large component moves them off the shares wanted."""
    per = splits.groupBy("split", "component").agg(F.count("*").alias("n")).groupBy("split").agg(F.sum("n").alias("rows"), F.count("*").alias("components"))
    total = splits.count()
    return per.withColumn("share", F.col("rows") / F.lit(float(max(total, 1))))
