"""Claims rebuilt from damaged fragment lists, as window operations over exploded entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.text import canceled_range, claim_number, dependencies, ends_complete, is_blank, normalize_text


def latest_rows(patents: DataFrame, key: str = "patent_id", at: str = "ingested_at") -> DataFrame:
    """One row a key, the latest; two narrow columns decide, the wide rows only join the result.

    Of rows of one time that differ, the one with the least hash counts.
    """
    columns = patents.columns
    latest = patents.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(at).alias("_a"))
    rows = patents.join(latest, (F.col(key) == F.col("_k")) & F.col(at).eqNullSafe(F.col("_a"))).drop("_k", "_a")
    return rows.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("_r")).select("_r.*")


def claim_segments(patents: DataFrame) -> DataFrame:
    """(patent_id, seg, pos, entry, explicit, lo, hi): each non-blank claim entry with the claim it belongs to.

    An entry opens a claim if it is a cancellation, is numbered, is the first, or follows a cancellation or an entry
    that ends like a sentence; any other continues the claim before.
    """
    entries = patents.select("patent_id", F.posexplode("claims_raw").alias("pos", "entry")).where(~is_blank(F.col("entry")))
    marked = entries.withColumns({"gone": canceled_range(F.col("entry")), "number": claim_number(F.col("entry"))})
    marked = marked.withColumn("complete", ends_complete(normalize_text(F.col("entry"))))
    w = Window.partitionBy("patent_id").orderBy("pos")
    opens = F.col("gone").isNotNull() | F.col("number").isNotNull() | F.coalesce(F.lag(F.col("gone").isNotNull() | F.col("complete")).over(w), F.lit(True))
    seg = F.sum(opens.cast("int")).over(w)
    explicit = F.when(opens, F.coalesce("gone.lo", "number"))
    return marked.select("patent_id", seg.cast("int").alias("seg"), "pos", "entry", explicit.alias("explicit"), F.col("gone.lo").alias("lo"), F.col("gone.hi").alias("hi"))


def numbered_segments(segments: DataFrame) -> DataFrame:
    """(patent_id, seg, number, explicit, lo, hi, fragments): a row a claim, with its number.

    A claim without a number takes the next explicit number less the distance if that is at least 1, else the number
    before (the end of a canceled range) plus one, else counts from 1. Along a run without numbers the candidates rise
    by one, so those below 1 come first and the rule has a closed form.
    """
    one = segments.groupBy("patent_id", "seg").agg(
        F.max("explicit").alias("explicit"),
        F.max("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.sort_array(F.collect_list(F.struct("pos", "entry"))).alias("fragments"),
    )
    w = Window.partitionBy("patent_id").orderBy("seg")
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    behind = w.rowsBetween(Window.unboundedPreceding, -1)
    there = F.col("explicit").isNotNull()
    nxt = F.first(F.when(there, F.struct("explicit", "seg")), ignorenulls=True).over(ahead)
    last = F.last(F.when(there, F.struct(F.coalesce("hi", "explicit").alias("base"), "seg")), ignorenulls=True).over(behind)
    found = one.withColumns({"nxt": nxt, "last": last})
    candidate = F.col("nxt.explicit") - (F.col("nxt.seg") - F.col("seg"))
    from_before = F.coalesce(F.col("last.base") + F.col("seg") - F.col("last.seg"), F.col("seg"))
    number = F.coalesce("explicit", F.when(candidate >= 1, candidate), from_before)
    return found.select("patent_id", "seg", number.cast("int").alias("number"), "explicit", "lo", "hi", "fragments")


def reconstruct_claims(patents: DataFrame) -> DataFrame:
    """Claims of each patent; see claim_segments and numbered_segments. Patents without entries have none."""
    segs = numbered_segments(claim_segments(patents))
    raw = F.trim(F.array_join(F.transform("fragments", lambda f: f["entry"]), " "))
    canceled = F.col("lo").isNotNull()
    status = (
        F.when(canceled, "canceled")
        .when(F.col("explicit").isNull(), "preamble_stripped")
        .when(F.size("fragments") > 1, "rejoined_continuation")
        .otherwise("original_complete")
    )
    texts = segs.withColumn("raw_text", raw).withColumn("text", normalize_text(F.col("raw_text")))
    deps = F.when(canceled, F.array().cast("array<int>")).otherwise(F.array_remove(dependencies(F.col("text")), F.col("number")))
    claim_id = F.when(canceled, F.format_string("%s:canceled:%d-%d", "patent_id", "lo", "hi")).otherwise(F.format_string("%s:claim:%d", "patent_id", "number"))
    return texts.withColumn("depends_on", deps).select(
        claim_id.alias("claim_id"),
        "patent_id",
        F.col("number").alias("claim_number"),
        "text",
        "raw_text",
        ((F.size("depends_on") == 0) & ~canceled).alias("is_independent"),
        "depends_on",
        status.alias("status"),
        F.transform("fragments", lambda f: f["pos"]).alias("raw_fragment_indexes"),
        F.col("explicit").isNull().alias("number_inferred"),
        "seg",
    )


def reconstruction_stats(claims: DataFrame) -> DataFrame:
    """One row of counts over all claims."""
    order = claims.where("status != 'canceled'").groupBy("patent_id").agg(F.sort_array(F.collect_list(F.struct("seg", "claim_number"))).alias("n"))
    jumbled = order.where(F.transform("n", lambda s: s["claim_number"]) != F.array_sort(F.transform("n", lambda s: s["claim_number"]))).agg(F.count("*").alias("patents_with_out_of_order_numbering"))
    counts = claims.agg(
        F.count("*").alias("claims_total"),
        F.count_if("is_independent").alias("independent"),
        F.count_if(F.size("depends_on") > 0).alias("dependent"),
        F.count_if("number_inferred").alias("number_inferred"),
        F.count_if(F.size("raw_fragment_indexes") > 1).alias("multi_fragment"),
        *[F.count_if(F.col("status") == s).alias(f"status_{s}") for s in ("canceled", "original_complete", "preamble_stripped", "rejoined_continuation")],
    )
    return counts.crossJoin(F.broadcast(jumbled))  # one row each


def uncovered_entries(patents: DataFrame, claims: DataFrame) -> DataFrame:
    """Invariant: non-blank entries that aren't used exactly once. Empty if all is well."""
    entries = patents.select("patent_id", F.posexplode("claims_raw").alias("pos", "entry")).where(~is_blank(F.col("entry"))).select("patent_id", "pos", F.lit(0).alias("n"))
    used = claims.select("patent_id", F.explode("raw_fragment_indexes").alias("pos"), F.lit(1).alias("n"))
    return entries.unionByName(used).groupBy("patent_id", "pos").agg(F.sum("n").alias("uses"), F.count("*").alias("rows")).where("uses != 1 OR rows != 2").select("patent_id", "pos", "uses")


def claim_parents(claims: DataFrame) -> DataFrame:
    """(claim_id, parent_id) of each claim and the claims of its patent that it depends on."""
    child = claims.select("claim_id", "patent_id", F.explode("depends_on").alias("claim_number"))
    parent = claims.where("status != 'canceled'").select("patent_id", "claim_number", F.col("claim_id").alias("parent_id"))
    return child.join(parent, ["patent_id", "claim_number"]).select("claim_id", "parent_id")
