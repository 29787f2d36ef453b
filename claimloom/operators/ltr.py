"""Learning to rank: features as column expressions, a gradient-boosted model, its report."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.functions.text import feature_tokens, seeded_hash
from claimloom.operators.fusion import RRF_K
from claimloom.session import ensure_checkpoint_dir

# The features' names in the order of the stored feature arrays.
FEATURES = [
    "bm25_rr", "vec_rr", "found_by_both", "bm25_only", "vec_only", "fused_score", "is_claim", "is_abstract", "is_summary",
    "is_description", "is_independent", "claim_number_norm", "text_len_norm", "query_len_norm", "term_overlap", "title_overlap",
]


def features(hits: DataFrame) -> DataFrame:
    """Hits (query, text, title, bm25_rank, vector_rank, score, record_type, claim_number) with the feature columns.

    is_independent is 1 for claim number 1, as stored feature rows have it; records without a claim number count as
    number 0.
    """
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    rr = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) != 0, F.lit(1.0) / (F.lit(RRF_K) + F.col(c))).otherwise(0.0)
    bm, ve = F.col("bm25_rank").isNotNull(), F.col("vector_rank").isNotNull()
    q = feature_tokens(F.coalesce("query", F.lit("")))

    def overlap(c: str) -> Column:
        return F.when(F.size(q) > 0, F.size(F.array_intersect(q, feature_tokens(F.coalesce(c, F.lit(""))))) / F.size(q)).otherwise(0.0)

    length = lambda c: F.least(F.length(F.coalesce(c, F.lit(""))) / F.lit(2000.0), F.lit(1.0))
    columns = [rr("bm25_rank"), rr("vector_rank"), flag(bm & ve), flag(bm & ~ve), flag(ve & ~bm), F.col("score").cast("double")]
    columns += [flag(F.col("record_type") == t) for t in ("claim", "abstract", "summary", "description")]
    columns += [flag(F.col("claim_number") == 1), F.lit(1.0) / F.log2(F.lit(2.0) + F.coalesce("claim_number", F.lit(0)))]
    columns += [length("text"), length("query"), overlap("text"), overlap("title")]
    return hits.withColumns(dict(zip(FEATURES, columns)))


def label_rows(rows: DataFrame, qrels: DataFrame) -> DataFrame:
    return rows.join(qrels.select("query_id", "record_id", F.col("grade").alias("label")), ["query_id", "record_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def usable_rows(feature_rows: DataFrame) -> DataFrame:
    """Stored rows as columns: ids tidied, rows of another width or with NaN or without a label left out.

    Of several rows of a query and record one counts: one with a patent before one without, then the least patent, then
    the least features and label.
    """
    tidy = lambda c: F.lower(F.trim(c))
    rows = feature_rows.where((F.size("features") == len(FEATURES)) & (F.col("label") >= 0) & ~F.exists("features", lambda x: F.isnan(x) | x.isNull()))
    patent = F.when(F.trim("patent_id") != "", tidy("patent_id"))
    named = rows.select(tidy("query_id").alias("query_id"), F.trim("record_id").alias("record_id"), F.struct(patent.isNull().alias("lacking"), patent.alias("patent_id"), "features", "label").alias("r"))
    one = named.groupBy("query_id", "record_id").agg(F.min("r").alias("r"))
    return one.select("query_id", "record_id", "r.patent_id", *[F.col("r.features")[i].alias(n) for i, n in enumerate(FEATURES)], "r.label")


def split_by_patent(rows: DataFrame, test_fraction: float = 0.25, seed: int = 17) -> DataFrame:
    """Rows with split train or test; a patent is in one only. The cut is at max(1, int(n * (1 - fraction))) patents in hash order."""
    h = seeded_hash(F.col("patent_id"), seed)
    patents = rows.select("patent_id").where("patent_id IS NOT NULL").distinct().select(h.alias("h"))
    edge = nth_least(patents, "h", lambda n: max(1, int(n * (1 - test_fraction))))
    return rows.where("patent_id IS NOT NULL").withColumn("split", F.when(h <= F.lit(edge), "train").otherwise("test"))


def nth_least(values: DataFrame, column: str, which) -> int | None:
    """The which(n)-th least of n numbers of 60 bits, or None of none: two counts by ranges, then one range is looked at.

    The numbers are hashes, so that ranges of their leading bits are even; no task sorts more than a range.
    """
    top = F.shiftright(column, 44)
    per = {r.t: r.n for r in values.groupBy(top.alias("t")).agg(F.count("*").alias("n")).collect()}  # at most 65,536 rows
    n = sum(per.values())
    if not n:
        return None
    left = which(n)
    for t in sorted(per):
        if left <= per[t]:
            break
        left -= per[t]
    return values.where(top == t).orderBy(column).limit(left).agg(F.max(column)).first()[0]


def train(rows: DataFrame, iterations: int = 300, depth: int = 4, step: float = 0.05, subsample: float = 0.9, seed: int = 17):
    """A fitted pipeline over rows with split = train. Raises ValueError without such rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    training = rows.where("split = 'train'").select(*FEATURES, F.col("label").cast("double").alias("label"))
    if training.isEmpty():
        raise ValueError("no training rows")
    ensure_checkpoint_dir(rows.sparkSession)  # boosting cuts its lineage every ten trees where there is a folder for it
    model = GBTRegressor(maxIter=iterations, maxDepth=depth, stepSize=step, subsamplingRate=subsample, seed=seed, labelCol="label", featuresCol="_features", predictionCol="rerank_score")
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="_features"), model]).fit(training)


def importances(model) -> list[tuple[str, float]]:
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(FEATURES, (round(float(v), 4) for v in values)), key=lambda x: (-x[1], x[0]))


def report(rows: DataFrame, model) -> dict:
    counts = {r["split"]: (r.n, r.p) for r in rows.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("patent_id").alias("p")).collect()}
    labels = {int(r.label): r["count"] for r in rows.groupBy("label").count().collect()}
    return {"rows": {k: v[0] for k, v in counts.items()}, "patents": {k: v[1] for k, v in counts.items()}, "labels": labels, "importances": importances(model)}


def save(model, path: str) -> None:
    """The model and, beside it, the names of the features it was trained on."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(FEATURES),)], "names string").coalesce(1).write.mode("overwrite").text(f"{path}/features")


def load(path: str):
    from pyspark.ml import PipelineModel

    names = json.loads(SparkSession.active().read.text(f"{path}/features").first()[0])
    if names != FEATURES:
        raise ValueError("the model was trained on other features")
    return PipelineModel.load(f"{path}/model")


def score_with_model(model, hits: DataFrame) -> DataFrame:
    """Hits with the model's rerank_score."""
    return model.transform(features(hits).drop("rerank_score")).drop("_features")


def rerank_with_model(model, hits: DataFrame) -> DataFrame:
    """Hits rescored by the model; the candidate set stays."""
    from claimloom.operators.rerank import rerank

    return rerank(score_with_model(model, hits), "rerank_score")


def label_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.count("*").alias("rows"), F.countDistinct("query_id").alias("queries")).orderBy("label")


def rank_by(rows: DataFrame, feature: str) -> DataFrame:
    """(query_id, record_id, rank, label) in the order of one feature."""
    w = Window.partitionBy("query_id").orderBy(F.desc(feature), "record_id")
    return rows.select("query_id", "record_id", "label", F.row_number().over(w).alias("rank"))
