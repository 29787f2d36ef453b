"""The reports of a corpus build: what the source held, and what was made of its claims."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators import claims, quality, records
from claimloom.session import materialise
from claimloom.sources.files import write_report


def write_reports(patents: DataFrame, issues: DataFrame, folder: str) -> None:
    """data_quality.json and extraction_quality.json, as lists of (section, key, value)."""
    os.makedirs(folder, exist_ok=True)
    write_report(quality.quality_report(patents, issues), os.path.join(folder, "data_quality.json"))
    write_report(extraction_report(patents), os.path.join(folder, "extraction_quality.json"))


def extraction_report(patents: DataFrame) -> DataFrame:
    """(section, key, value): the counts of the claims that were reconstructed, and the patents' claims that share a number."""
    found = claims.reconstruct_claims(patents)
    stats = claims.reconstruction_stats(found)
    long = stats.select(F.explode(F.array(*[F.struct(F.lit("claims").alias("section"), F.lit(c).alias("key"), F.col(c).cast("long").alias("value")) for c in stats.columns])).alias("s")).select("s.*")
    twice = found.groupBy("claim_id").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("value"))
    return long.unionByName(twice.select(F.lit("claims").alias("section"), F.lit("numbers_given_twice").alias("key"), "value"))


def build_corpus(patents: DataFrame, issues: DataFrame, folder: str | None = None) -> DataFrame:
    """The search records of a corpus; with a folder, its two reports are written beside."""
    made = materialise(records.build_records(patents, claims.reconstruct_claims(patents)))
    if folder:
        write_reports(patents, issues, folder)
    return made
