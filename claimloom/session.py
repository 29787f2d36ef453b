"""Session defaults and the two helpers every multi-stage operator shares: lineage cuts and skew-safe joins."""

from __future__ import annotations

import re
import tempfile

from pyspark import SparkConf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the engine's defaults, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("claimloom")
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": "8", **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def session(app: str = "claimloom") -> SparkSession:
    """The session that spark-submit configures; what it leaves open has the engine's defaults, a missing master is local."""
    given = SparkConf()
    builder = SparkSession.builder.appName(given.get("spark.app.name", app))
    if not given.contains("spark.master"):
        builder = builder.master("local[*]")
    for key, value in DEFAULTS.items():
        if not given.contains(key):
            builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder the cluster names in spark.checkpoint.dir. A local session without one gets a folder of its own.

    On a cluster, a folder of one machine would be read by others: without a shared one this raises.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {sc.master} share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="claimloom-"))


def materialise(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A top-level column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")
