"""The engine's operators over the driver's tables, one query each."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.functions import analyzer, models, text
from claimloom.operators import claims, dense, evalset, fusion, jobs, lexical, ltr, metrics, pooling, quality, records, rerank, significance
from claimloom.operators.filters import Filters
from claimloom.plans import reports
from claimloom.plans.engine import SearchEngine, check_request
from claimloom.session import ensure_checkpoint_dir, read_table
from claimloom.sources import corpus, files
from claimloom.streaming import ingest

HIT_FIELDS = ["record_id", "patent_id", "record_type", "title", "text", "classification_raw", "claim_number"]
BARE = [*HIT_FIELDS, "abstract", "classification_section", "classification_class", "classification_subclass", "is_independent", "paragraph_start", "paragraph_end"]
SYNONYMS = analyzer.canonical_synonyms(analyzer.SYNONYM_GROUPS)


def _records(spark: SparkSession, d: str, columns: list[str] | None = None) -> DataFrame:
    return read_table(spark, d, "search_records").select(columns or BARE).distinct()


def _patents(spark: SparkSession, d: str) -> DataFrame:
    return claims.latest_rows(read_table(spark, d, "patents"))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return claims.reconstruct_claims(_patents(spark, d))


def _eval(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "eval_queries")


def _run(spark: SparkSession, d: str) -> DataFrame:
    """(system, query_id, record_id, rank): each method's hits of a query, best score first."""
    h = read_table(spark, d, "hits").where(~F.isnan("score") & F.col("score").isNotNull() & F.col("record_id").isNotNull())
    best = h.groupBy(F.col("method").alias("system"), "query_id", "record_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("system", "query_id").orderBy(F.desc("score"), "record_id")
    return best.withColumn("rank", F.row_number().over(w)).drop("score")


def _per_query(spark: SparkSession, d: str) -> DataFrame:
    return metrics.evaluate(_run(spark, d), metrics.explode_qrels(_eval(spark, d)), _eval(spark, d))


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(f"`{c}`", digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    """A job table: the first delivery of each patent, in a state that its number decides."""
    p = read_table(spark, d, "patents").where("patent_id IS NOT NULL").groupBy("patent_id").agg(F.min("ingested_at").alias("at"), F.min("source_file").alias("source_file"))
    n = F.expr("cast(substring(patent_id, -2) AS int)")
    state = F.when(n % 5 == 0, "FAILED").when(n % 5 == 1, "PENDING").when(n % 5 == 2, "EMBEDDING").otherwise("COMPLETED")
    at = F.unix_micros("at") / F.lit(1000000.0)
    return p.select(
        "patent_id", "source_file", F.sha2("patent_id", 256).alias("source_hash"), state.alias("status"), F.lit("1").alias("parser_version"), F.lit(None).cast("string").alias("embedding_model"),
        F.when(state == "COMPLETED", n).otherwise(0).cast("long").alias("record_count"), F.when(state == "FAILED", 3).otherwise(n % 4).cast("int").alias("retry_count"), F.when(state == "FAILED", "ValueError").alias("last_error"),
        F.when(state == "EMBEDDING", "w1").alias("worker_id"), F.when(state == "EMBEDDING", at).alias("leased_at"), at.alias("updated_at"),
    )


NOW = 1733000000.0


def project_fields(spark, d):
    return _records(spark, d, HIT_FIELDS)


def _filtered(f: Filters):
    return lambda spark, d: f.apply(_records(spark, d)).select("record_id")


def filter_exact_title(spark, d):
    first = read_table(spark, d, "search_records").agg(F.min("title")).first()[0]
    return Filters(exact_title=first).apply(_records(spark, d)).select("record_id")


def filter_exclude_patent(spark, d):
    first = read_table(spark, d, "search_records").agg(F.min("patent_id")).first()[0]
    return Filters(exclude_patent=first).apply(_records(spark, d)).select("record_id")


def normalize_claims(spark, d):
    each = _patents(spark, d).select("patent_id", F.posexplode("claims_raw").alias("pos", "entry"))
    return each.select("patent_id", "pos", text.normalize_text(F.col("entry")).alias("normal"), text.is_blank(F.col("entry")).alias("blank"))


def word_counts(spark, d):
    return _patents(spark, d).select("patent_id", text.word_count(F.col("abstract")).alias("words"), F.substring("abstract", 1, 400).alias("preview"))


def claim_segments(spark, d):
    return claims.claim_segments(_patents(spark, d)).select("patent_id", "seg", "pos", "explicit")


def claim_numbers(spark, d):
    return claims.numbered_segments(claims.claim_segments(_patents(spark, d))).select("patent_id", "seg", "number")


def reconstruct_claims(spark, d):
    return _claims(spark, d).select("claim_id", "patent_id", "claim_number", "status", "is_independent", "raw_fragment_indexes", "number_inferred", "depends_on")


def reconstruction_stats(spark, d):
    return claims.reconstruction_stats(_claims(spark, d))


def claim_parents(spark, d):
    return claims.claim_parents(_claims(spark, d))


def claim_invariant(spark, d):
    p = _patents(spark, d)
    return claims.uncovered_entries(p, claims.reconstruct_claims(p))


def build_records(spark, d):
    p = _patents(spark, d)
    return records.build_records(p, claims.reconstruct_claims(p)).select(BARE)


def chunk_passages(spark, d):
    p = _patents(spark, d).select("patent_id", text.normalize_paragraphs(F.col("description_paragraphs")).alias("paragraphs"))
    return records.chunk_passages(p, "patent_id", "paragraphs")


def _index(spark, d) -> lexical.LexicalIndex:
    return lexical.build_index(_records(spark, d), synonyms=SYNONYMS)


def term_statistics(spark, d):
    return _index(spark, d).terms


def field_statistics(spark, d):
    return _rounded(_index(spark, d).stats)


def bm25_topk(spark, d):
    return lexical.bm25_search(_index(spark, d), _eval(spark, d), 10, synonyms=SYNONYMS)


def bm25_filtered(spark, d):
    return lexical.bm25_search(_index(spark, d), _eval(spark, d), 10, Filters(classification_prefix="B60", record_types=["claim"]), synonyms=SYNONYMS)


def bm25_keyword(spark, d):
    """A title filter on an index, whose analysed titles it reads."""
    return lexical.bm25_search(_index(spark, d), _eval(spark, d), 10, Filters(title_keyword="tires, wheel", synonyms=SYNONYMS), synonyms=SYNONYMS)


def bm25_postings(spark, d):
    """By the postings of the queries' terms instead of a scan."""
    index = lexical.build_index(_records(spark, d), synonyms=SYNONYMS, counted=True)
    return lexical.postings_search(index, lexical.postings(index), _eval(spark, d), 10, Filters(classification_prefix="B60", record_types=["claim"]), synonyms=SYNONYMS)


def posting_lists(spark, d):
    """How many records and occurrences each term of a field has by its postings."""
    index = _index(spark, d)
    per = lexical.postings(index).groupBy("field", "h").agg(F.count("*").alias("records"), F.sum("tf").alias("occurrences"))
    return index.terms.select("field", "term", F.xxhash64("term").alias("h")).join(per, ["field", "h"], "left").select("field", "term", "records", "occurrences")


def bm25_plain(spark, d):
    """Without synonyms and stems."""
    return lexical.bm25_search(lexical.build_index(_records(spark, d), stem=False), _eval(spark, d), 10, stem=False)


def _vectors(spark, d) -> DataFrame:
    """(query_id, vector): each query stands for the summary of the patent it was made from."""
    own = _eval(spark, d).where("source_patent_id IS NOT NULL").select("query_id", F.concat("source_patent_id", F.lit(":summary")).alias("record_id"))
    return read_table(spark, d, "search_records").select("record_id", "embedding").distinct().join(own, "record_id").select("query_id", F.col("embedding").alias("vector")).where("size(vector) = 64")


def _dense_records(spark, d) -> DataFrame:
    return _records(spark, d, [*BARE, "embedding"])


def dense_topk(spark, d):
    return dense.dense_search(_dense_records(spark, d), _vectors(spark, d), 10)


def dense_filtered(spark, d):
    return dense.dense_search(_dense_records(spark, d), _vectors(spark, d), 10, Filters(record_types=["claim"], independent_only=True))


def dense_table(spark, d):
    e = read_table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return dense.dense_search(e, q, 10, key="vec_id")


def _hybrid(spark, d, k: int = 20) -> DataFrame:
    words = lexical.bm25_search(_index(spark, d), _eval(spark, d), 50, synonyms=SYNONYMS)
    return fusion.fuse(words, dense.dense_search(_dense_records(spark, d), _vectors(spark, d), 50), k)


def hybrid_topk(spark, d):
    return _rounded(_hybrid(spark, d))


def hybrid_grouped(spark, d):
    hits = _hybrid(spark, d).join(_records(spark, d, ["record_id", "patent_id"]), "record_id")
    return _rounded(fusion.group_hits(hits))


def group_runs(spark, d):
    """The hits of each run by patent, in the order of their scores."""
    h = read_table(spark, d, "hits").where(F.col("score").isNotNull() & ~F.isnan("score"))
    best = h.groupBy("run_id", "record_id", "patent_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("run_id").orderBy(F.desc("score"), "record_id")
    ranked = best.withColumn("rank", F.row_number().over(w)).withColumnRenamed("run_id", "query_id")
    return _rounded(fusion.group_hits(ranked), 6)


def engine_search(spark, d):
    """The whole search: hybrid candidates, of queries embedded by hashing, reranked by the registry's offline stand-in."""
    engine = SearchEngine.over(_dense_records(spark, d), SYNONYMS, embed=lambda c: text.hashing_embedding(c, 64), scorer="overlap")
    hits = engine.hits(_eval(spark, d), "hybrid_reranked", 10, 50)
    return engine.served(hits).select("query_id", "record_id", "score", "rerank_score", "bm25_rank", "vector_rank", "rank", "text")


def engine_patents(spark, d):
    """Its patents as they are given out."""
    engine = SearchEngine.over(_dense_records(spark, d), SYNONYMS, embed=lambda c: text.hashing_embedding(c, 64), scorer="overlap")
    _, patents = engine.search(_eval(spark, d), method="bm25", top_k=20, candidates=20)
    return engine.served_patents(patents).select("query_id", "patent_id", "score", "best", "supporting", "supporting_count", "rank")


def request_checks(spark, d):
    """What a search accepts, from one request each."""
    engine = SearchEngine(None, None, embed=lambda c: c)
    cases = {
        "fits": lambda: (engine.check("hybrid", 10, 50), check_request("q", Filters(classification_prefix="B60B"))),
        "unknown method": lambda: engine.check("fuzzy", 10, 50),
        "no reranker": lambda: engine.check("hybrid_reranked", 10, 50),
        "no embedder": lambda: SearchEngine(None, None).check("dense", 10, 50),
        "fewer candidates than results": lambda: engine.check("hybrid", 50, 10),
        "too many results": lambda: engine.check("bm25", 101, 200),
        "no results": lambda: engine.check("bm25", 0, 50),
        "empty query": lambda: check_request(""),
        "longest query": lambda: check_request("x" * 8000),
        "query too long": lambda: check_request("x" * 8001),
        "prefix too long": lambda: check_request("q", Filters(classification_prefix="x" * 17)),
        "keyword too long": lambda: check_request("q", Filters(title_keyword="x" * 201)),
        "title too long": lambda: check_request("q", Filters(exact_title="x" * 401)),
        "patent too long": lambda: check_request("q", Filters(exclude_patent="x" * 33)),
        "known embedder": lambda: models.parse_spec("bge-small"),
        "unknown embedder": lambda: models.parse_spec("nothing:x"),
        "known reranker": lambda: models.reranker("off"),
        "unknown reranker": lambda: models.reranker("best"),
    }
    rows = []
    for name, run in cases.items():
        try:
            run()
            rows.append((name, True))
        except ValueError:
            rows.append((name, False))
    return spark.createDataFrame(rows, "request string, accepted boolean")


def facet_subclass(spark, d):
    return quality.facet(_records(spark, d), "classification_subclass")


def facet_record_type(spark, d):
    return quality.facet(_records(spark, d), "record_type")


def corpus_stats(spark, d):
    return quality.corpus_stats(_records(spark, d))


def patent_lookup(spark, d):
    first = read_table(spark, d, "patents").agg(F.min("patent_id")).first()[0]
    return _patents(spark, d).where(F.col("patent_id") == first).select("patent_id", "title", F.filter("description_paragraphs", lambda p: F.trim(p) != "").alias("paragraphs"))


def latest_patents(spark, d):
    return _patents(spark, d).select("patent_id", "ingested_at", "source_file")


def validate_issues(spark, d):
    return quality.table_issues(_patents(spark, d))


def quality_report(spark, d):
    p = _patents(spark, d)
    return quality.quality_report(p, quality.table_issues(p))


def evaluate_queries(spark, d):
    return _rounded(_per_query(spark, d))


def evaluate_systems(spark, d):
    return _rounded(metrics.macro_average(_per_query(spark, d)))


def latency_percentiles(spark, d):
    h = read_table(spark, d, "hits").where("logged_at IS NOT NULL AND searched_at IS NOT NULL")
    ms = h.select("method", ((F.unix_micros("logged_at") - F.unix_micros("searched_at")) / F.lit(1000.0)).alias("ms"))
    return _rounded(metrics.nearest_rank(ms, "method", "ms"), 4)


def pool_candidates(spark, d):
    return pooling.build_pool(_run(spark, d))


def pool_stats(spark, d):
    return pooling.pool_stats(pooling.build_pool(_run(spark, d)))


def pool_unjudged(spark, d):
    return pooling.judge_batches(pooling.unjudged(pooling.build_pool(_run(spark, d)), metrics.explode_qrels(_eval(spark, d)))).select("query_id", "record_id", "batch")


def merge_qrels(spark, d):
    judged = pooling.build_pool(_run(spark, d)).select("query_id", "record_id", (F.col("best_rank") % 4).alias("grade"))
    return pooling.merge_qrels(_eval(spark, d).select("query_id", F.explode("qrels").alias("record_id", "grade")), judged)


def t_test_terms(spark, d):
    return _rounded(significance.t_terms(_per_query(spark, d), "ndcg@10", "bm25"), 6)


def compare_systems(spark, d):
    return _rounded(significance.compare_systems(_per_query(spark, d), "ndcg@10", "bm25"), 6)


def compare_t(spark, d):
    return _rounded(significance.compare_systems(_per_query(spark, d), "ndcg@10", "bm25", "t"), 6).drop("p_value", "significant")


def comparison_lines(spark, d):
    """The table of the systems' means, as it is printed."""
    rows = metrics.macro_average(_per_query(spark, d)).orderBy("system").collect()
    lines = significance.comparison_table(rows, ["recall@10", "ndcg@10", "mrr@10"]).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "no int, line string")


def trec_run(spark, d):
    return significance.trec_run(_run(spark, d).where("system = 'hybrid'"), "hybrid").select("query_id", "line")


def eval_set(spark, d):
    q = evalset.build_eval_set(_records(spark, d))
    return q.select("query_id", "text", "source_patent_id", "query_type", F.explode("qrels").alias("record_id", "grade"))


def eval_set_lines(spark, d):
    """Evaluation queries written as lines and read again, behind a line of notes."""
    head = spark.createDataFrame([('{"_notes": {"seed": 13}}',)], "value string")
    queries, notes = files.parse_eval_set(files.eval_set_lines(_eval(spark, d)).unionByName(head))
    return queries.select("query_id", "text", "source_patent_id", "query_type", F.size("qrels").alias("relevant"), F.lit(notes["seed"]).alias("seed"))


def paraphrase(spark, d):
    """Queries rewritten by a stand-in that fails on every text of odd length."""

    def rewrite(t: str) -> str:
        if len(t) % 2:
            raise ValueError("odd")
        return f"in other words: {t}"

    return evalset.paraphrase(_eval(spark, d), rewrite).select("query_id", "text", F.size("qrels").alias("relevant"))


def judge_pool(spark, d):
    """Structural grades where there are any, else an assessor's, cut to 0 to 3."""
    pool = pooling.build_pool(_run(spark, d))
    return pooling.judge_pool(pool, metrics.explode_qrels(_eval(spark, d)), F.col("best_rank") % 6 - 1)


def apply_judgements(spark, d):
    judged = pooling.build_pool(_run(spark, d)).select("query_id", "record_id", (F.col("best_rank") % 4).alias("grade"))
    q = pooling.apply_judgements(_eval(spark, d), judged, keep_structural=False)
    return q.select("query_id", "source_patent_id", F.explode("qrels").alias("record_id", "grade"))


def first_judgements(spark, d):
    """Of a cache that only grows, the first grade of each pair."""
    h = read_table(spark, d, "hits").where("record_id IS NOT NULL AND logged_at IS NOT NULL AND bm25_rank >= 1")
    cache = h.groupBy("query_id", "record_id", "logged_at").agg((F.max("bm25_rank") % 4).alias("grade"))
    return pooling.first_judgements(cache, "logged_at")


def overlap_report(spark, d):
    return evalset.overlap_report(_eval(spark, d), _records(spark, d))


def cross_patent(spark, d):
    return evalset.cross_patent(_eval(spark, d))


def _ranked_hits(spark, d) -> DataFrame:
    """One row for each query and record that was hit, with its best ranks and score, and the texts."""
    h = read_table(spark, d, "hits").where(F.col("record_id").isNotNull())
    rank = lambda c: F.min(F.when(F.col(c) >= 1, F.col(c))).alias(c)
    one = h.groupBy("query_id", "record_id").agg(rank("bm25_rank"), rank("vector_rank"), F.max(F.when(~F.isnan("score"), F.col("score"))).alias("score"))
    q = _eval(spark, d).select("query_id", F.col("text").alias("query"))
    return one.join(q, "query_id").join(_records(spark, d, ["record_id", "record_type", "title", "text", "claim_number"]), "record_id")


def ltr_features(spark, d):
    return _rounded(ltr.features(_ranked_hits(spark, d)).select("query_id", "record_id", *ltr.FEATURES))


def ltr_labels(spark, d):
    rows = ltr.label_rows(_ranked_hits(spark, d), metrics.explode_qrels(_eval(spark, d)))
    return ltr.label_distribution(rows).select("label", "rows", "queries")


def ltr_usable_rows(spark, d):
    return ltr.usable_rows(read_table(spark, d, "feature_rows")).groupBy("query_id").agg(F.count("*").alias("rows"))


def ltr_split(spark, d):
    return ltr.split_by_patent(ltr.usable_rows(read_table(spark, d, "feature_rows"))).select("query_id", "record_id", "patent_id", "split")


def ltr_rerank(spark, d):
    rows = ltr.split_by_patent(ltr.usable_rows(read_table(spark, d, "feature_rows")))
    model = ltr.train(rows)
    return ltr.rank_by(model.transform(rows.where("split = 'test'")), "rerank_score")


def rerank_identity(spark, d):
    hits = _ranked_hits(spark, d).where("score IS NOT NULL").select("query_id", "record_id", "score")
    ranked = lexical.top_k(hits, 20)
    return rerank.rerank(ranked, rerank.identity_score()).select("query_id", "record_id", "rerank_score", "rank")


def rerank_overlap(spark, d):
    hits = _ranked_hits(spark, d).where("score IS NOT NULL").select("query_id", "record_id", "score", "query", "text")
    return _rounded(rerank.rerank(lexical.top_k(hits, 20), rerank.overlap_score(), 10).select("query_id", "record_id", "rerank_score", "rank"))


def _first_hits(spark, d) -> DataFrame:
    hits = _ranked_hits(spark, d).where("score IS NOT NULL").select("query_id", "record_id", "score", "query", "text")
    return lexical.top_k(hits, 20)


def rerank_pairs(spark, d):
    """A pair model behind the registry; the stand-in scores a pair by the length of its text, as far as it is read."""
    models.register_pair_model("length", lambda name: lambda pairs: [float(len(t)) for _, t in pairs])
    return rerank.rerank(models.reranker("length:pairs")(_first_hits(spark, d)), "rerank_score", 10).select("query_id", "record_id", "rerank_score", "rank")


def rerank_graded(spark, d):
    """A grading model behind the registry, asked about ten texts at a time; the stand-in leaves every other one out."""

    def ask(query: str, texts: list[str]) -> str:
        return json.dumps([{"id": i, "score": len(t) % 4} for i, t in enumerate(texts) if i % 2 == 0] + [{"id": 99, "score": 3}])

    models.register_grader("length-grade", lambda name: ask)
    return models.reranker("length-grade:texts")(_first_hits(spark, d)).select("query_id", "record_id", "rerank_score")


def embed_registered(spark, d):
    """Vectors of a registered provider, with the query prefix that its family wants."""
    models.register_loader("bge-letters", lambda name: lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts])
    v = models.embedder("bge-letters:bge", queries=True)(F.col("text"))
    return _eval(spark, d).select("query_id", F.posexplode(v).alias("i", "x")).withColumn("x", F.col("x").cast("double"))


def lexical_overlap(spark, d):
    doc = _records(spark, d, ["record_id", "text"]).withColumnRenamed("text", "doc")
    q = _eval(spark, d).select("query_id", F.col("text").alias("query"), F.explode("qrels").alias("record_id", "grade"))
    return _rounded(q.join(doc, "record_id").select("query_id", "record_id", text.lexical_overlap(F.col("query"), F.col("doc")).alias("overlap")))


def synonym_terms(spark, d):
    terms = analyzer.analyze(F.col("text"), SYNONYMS, stem=False)
    return _eval(spark, d).select("query_id", terms.alias("terms"))


def stem_terms(spark, d):
    return _eval(spark, d).select("query_id", analyzer.analyze(F.col("text"), SYNONYMS).alias("terms"))


def content_hash(spark, d):
    return _patents(spark, d).select("patent_id", text.content_hash(F.concat_ws("|", "patent_id", "title", "classification_raw")).alias("hash"))


def hashing_embed(spark, d):
    v = text.hashing_embedding(F.col("text"), 40)
    return _eval(spark, d).select("query_id", F.posexplode(F.transform(v, lambda x: F.round(x, 9))).alias("i", "x"))


def job_enqueue_decision(spark, d):
    p = read_table(spark, d, "patents").where("patent_id IS NOT NULL").groupBy("patent_id").agg(F.max("source_file").alias("source_file"), F.count("*").alias("n"))
    changed = F.when(F.col("n") > 1, F.sha2(F.concat("patent_id", F.lit("x")), 256)).otherwise(F.sha2("patent_id", 256))
    incoming = p.select("patent_id", "source_file", changed.alias("source_hash"), F.lit("1").alias("parser_version"), F.lit(None).cast("string").alias("embedding_model"))
    return jobs.enqueue_decisions(_jobs(spark, d), incoming).select("patent_id", "queue")


def job_counts(spark, d):
    return jobs.counts(_jobs(spark, d))


def job_summary(spark, d):
    return jobs.summary(_jobs(spark, d))


def job_failures(spark, d):
    return jobs.failures(_jobs(spark, d)).select("patent_id", "last_error", "retry_count")


def job_claim(spark, d):
    return jobs.claim(_jobs(spark, d), "w9", 25, NOW).where("worker_id = 'w9'").select("patent_id", "status", "leased_at")


def job_reclaim(spark, d):
    return jobs.counts(jobs.reclaim_stale(_jobs(spark, d), NOW))


def job_advance(spark, d):
    """Embedding jobs at the next stage, their leases renewed."""
    j = _jobs(spark, d)
    after = jobs.advance(j, j.where("status = 'EMBEDDING'").select("patent_id"), "INDEXING", NOW)
    return after.select("patent_id", "status", "leased_at", "worker_id")


def job_outcomes(spark, d):
    """Pending jobs of even number completed, the others failed once more."""
    j = _jobs(spark, d)
    n = F.expr("cast(substring(patent_id, -2) AS int)")
    out = j.where("status IN ('PENDING', 'EMBEDDING')").select("patent_id", F.lit(7).alias("record_count"), F.when(n % 2 == 1, F.repeat(F.lit("E"), 2100)).alias("error"))
    after = jobs.apply_outcomes(j, out, NOW)
    return after.select("patent_id", "status", "record_count", "retry_count", F.length("last_error").alias("error_chars"), "worker_id", "updated_at")


def job_lookup(spark, d):
    first = read_table(spark, d, "patents").agg(F.min("patent_id")).first()[0]
    return jobs.get(_jobs(spark, d), first).select("patent_id", "status", "retry_count")


def _folder(spark) -> str:
    """A new folder in the shared one, for queries that write tables and read them again."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def ingest_jobs(spark, d):
    """The job table after all deliveries were ingested, through leases, stages and retries."""
    where = _folder(spark)
    table, made = ingest.JobTable(spark, f"{where}/jobs"), ingest.RecordTable(spark, f"{where}/records")
    ingest.ingest_batch(read_table(spark, d, "patents"), table, made.append, "1")
    return table.read().select("patent_id", "status", "record_count", "retry_count", "last_error")


def ingest_again(spark, d):
    """The records of the latest delivery of each patent, after the first deliveries were ingested before."""
    where = _folder(spark)
    table, made = ingest.JobTable(spark, f"{where}/jobs"), ingest.RecordTable(spark, f"{where}/records")
    p = read_table(spark, d, "patents")
    first = p.join(p.groupBy("patent_id").agg(F.min("ingested_at").alias("ingested_at")), ["patent_id", "ingested_at"], "left_semi")
    ingest.ingest_batch(first, table, made.append, "1")
    ingest.ingest_batch(p, table, made.append, "1")
    return made.read().where("record_type = 'claim'").select("record_id", "text")


def records_upsert(spark, d):
    """Claims replaced by a later version of theirs, other records kept."""
    r = _records(spark, d, ["record_id", "record_type", "text"])
    new = r.where("record_type = 'claim'").withColumn("text", F.concat(F.lit("v2 "), "text"))
    return files.upsert_records(r, new).select("record_id", "text")


def records_with_vectors(spark, d):
    """Records and vectors kept apart, joined for an index; vectors of claims only, so that other records have none."""
    table = read_table(spark, d, "search_records")
    vectors = table.where("record_type = 'claim' AND size(embedding) = 64").select("record_id", F.col("embedding").alias("vector"))
    made = records.with_vectors(_records(spark, d, ["record_id", "record_type"]), vectors)
    return made.select("record_id", "record_type", F.col("embedding").isNotNull().alias("embedded"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


def ltr_report(spark, d):
    """Rows, patents and labels of either part of the split."""
    rows = ltr.split_by_patent(ltr.usable_rows(read_table(spark, d, "feature_rows")))
    return rows.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("patent_id").alias("patents"), *[F.count_if(F.col("label") == g).alias(f"label_{g}") for g in range(4)])


def records_json(spark, d):
    """Records as JSON lines without null fields, and read again."""
    r = _records(spark, d)
    lines = r.select(F.to_json(F.struct(*BARE)).alias("j"))
    return lines.where(~F.col("j").contains(":null")).select(F.from_json("j", r.schema).alias("r")).select("r.*")


def _corpus(spark, d) -> DataFrame:
    """(file, value): the patents as JSON arrays, with elements that are no records, records repeated in a second file,
    and records without a field."""
    n = F.expr("cast(substring(patent_id, -2) AS int)")
    fields = [F.col("title"), F.col("patent_id").alias("doc_number"), "abstract", F.col("description_paragraphs").alias("detailed_description"), F.col("classification_raw").alias("classification"), "filename", "bibtex"]
    whole, lacking = F.to_json(F.struct(*fields, F.col("claims_raw").alias("claims")), {"ignoreNullFields": "false"}), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    element = F.when(n % 10 == 3, lacking).otherwise(whole)
    first = _patents(spark, d).select(F.format_string("patents_a%02d.json", n).alias("file"), "patent_id", element.alias("e"))
    again = first.where(n % 10 == 1).withColumn("file", F.regexp_replace("file", "_a", "_b"))
    grouped = first.unionByName(again).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("patent_id", "e"))).alias("es"))
    return grouped.select("file", F.concat(F.lit('[1, "no record", null, '), F.concat_ws(", ", F.transform("es", lambda x: x["e"])), F.lit(", [2]]")).alias("value"))


def corpus_patents(spark, d):
    patents, _ = corpus.typed_corpus(corpus.parse_files(_corpus(spark, d)))
    return patents.select("patent_id", "title", "abstract", "classification_raw", F.size("claims_raw").alias("claims"), F.size("description_paragraphs").alias("paragraphs"), "source_file", "has_description")


def corpus_issues(spark, d):
    _, issues = corpus.typed_corpus(corpus.parse_files(_corpus(spark, d)))
    return issues.select("patent_id", "field", "issue", "severity", "file")


def extraction_report(spark, d):
    return reports.extraction_report(_patents(spark, d))


def event_windows(spark, d):
    return _rounded(ingest.event_counts(read_table(spark, d, "events")), 4)


def distinct_hits(spark, d):
    return ingest.latest_hits(read_table(spark, d, "hits").where("run_id IS NOT NULL AND record_id IS NOT NULL")).groupBy("run_id").agg(F.count("*").alias("hits"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        project_fields, filter_exact_title, filter_exclude_patent, normalize_claims, word_counts, claim_segments, claim_numbers, reconstruct_claims, reconstruction_stats, claim_parents, claim_invariant,
        build_records, chunk_passages, term_statistics, field_statistics, bm25_topk, bm25_filtered, bm25_keyword, bm25_plain, bm25_postings, posting_lists, dense_topk, dense_filtered, dense_table, hybrid_topk, hybrid_grouped, group_runs, engine_search, engine_patents, request_checks,
        facet_subclass, facet_record_type, corpus_stats, patent_lookup, latest_patents, validate_issues, quality_report, evaluate_queries, evaluate_systems, latency_percentiles, pool_candidates, pool_stats,
        pool_unjudged, merge_qrels, t_test_terms, compare_systems, compare_t, comparison_lines, trec_run, eval_set, eval_set_lines, paraphrase, judge_pool, apply_judgements, first_judgements, overlap_report, cross_patent, ltr_features, ltr_labels, ltr_usable_rows, ltr_split, ltr_report, ltr_rerank, rerank_identity,
        rerank_overlap, rerank_pairs, rerank_graded, embed_registered, lexical_overlap, synonym_terms, stem_terms, content_hash, hashing_embed, job_enqueue_decision, job_counts, job_summary, job_failures, job_claim, job_reclaim, job_advance, job_outcomes, job_lookup, ingest_jobs, ingest_again, records_upsert, records_with_vectors, records_json, corpus_patents, corpus_issues, extraction_report, event_windows, distinct_hits,
    )
}
QUERIES |= {
    "filter_prefix": _filtered(Filters(classification_prefix="B60C")),
    "filter_title_keyword": _filtered(Filters(title_keyword="tire wheels", synonyms=SYNONYMS)),
    "filter_abstract_keyword": _filtered(Filters(abstract_keyword="rubber deflated", synonyms=SYNONYMS)),
    "filter_record_types": _filtered(Filters(record_types=["claim", "summary"])),
    "filter_independent": _filtered(Filters(independent_only=True)),
    "filters_combined": _filtered(Filters(classification_prefix="B60", title_keyword="tire", record_types=["claim"], independent_only=True, synonyms=SYNONYMS)),
}
