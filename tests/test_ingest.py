import json

import pytest
from pyspark.sql import functions as F

from claimloom.operators import jobs as J
from claimloom.operators import quality
from claimloom.sources import corpus, files
from claimloom.streaming import ingest

RECORD = {"title": "SPOKE", "doc_number": "20240051333", "filename": "US.XML", "abstract": "A spoke includes an axle body.", "detailed_description": ["Some real paragraph text here."], "claims": ["an axle body having a middle segment;", "2 . The spoke of claim 1 ."], "bibtex": "@misc{}", "classification": "B60B104FI"}


def corpus_of(tmp_path, *lists):
    for i, records in enumerate(lists):
        (tmp_path / f"patents_{i:02d}.json").write_text(records if isinstance(records, str) else json.dumps(records, ensure_ascii=False), encoding="utf-8")
    return str(tmp_path)


@pytest.mark.parametrize("change,want", [
    ({}, set()), ({"claims": None}, {("claims", "error")}), ({"detailed_description": ["", "  ", "⁢"]}, {("detailed_description", "warning")}), ({"claims": []}, {("claims", "error")}), ({"claims": ["", "  "]}, {("claims", "error")}),
    ({"title": "  "}, {("title", "warning")}), ({"doc_number": ""}, {("doc_number", "error")}), ({"claims": "1 . One text."}, set()), ({"claims": [None, "1 . A."]}, set()), ({"doc_number": 20240051333}, set()),
])
def test_issues(spark, tmp_path, change, want):
    patents, issues = corpus.load_corpus(spark, corpus_of(tmp_path, [RECORD | change]))
    assert {(r.field, r.severity) for r in issues.collect()} == want
    assert patents.count() == int(not any(s == "error" for _, s in want))


def test_absent_field(spark, tmp_path):
    record = {k: v for k, v in RECORD.items() if k != "claims"}
    _, issues = corpus.load_corpus(spark, corpus_of(tmp_path, [record]))
    assert {(r.field, r.issue) for r in issues.collect()} == {("claims", "field absent"), ("claims", "no non-blank claims")}


def test_bad_corpora(spark, tmp_path):
    with pytest.raises(corpus.CorpusError):
        corpus.load_corpus(spark, str(tmp_path))
    for i, text in enumerate(("{not json", '{"a": 1}')):
        d = tmp_path / str(i)
        d.mkdir()
        with pytest.raises(corpus.CorpusError, match="patents_00"):
            corpus.load_corpus(spark, corpus_of(d, text))


def test_other_elements_and_duplicates(spark, tmp_path):
    patents, issues = corpus.load_corpus(spark, corpus_of(tmp_path, [RECORD, "junk", 5, None, [1]], [RECORD]))
    assert patents.count() == 1
    assert [r.issue for r in issues.collect()] == ["duplicate across corpus"]
    row = patents.first()
    assert row.source_file == "patents_00.json" and row.has_description and len(row.source_hash) == 64
    report = {(r.section, r.key): r.value for r in quality.quality_report(patents, issues).collect()}
    assert report["corpus", "patents_loaded"] == 1 and report["issues_by_severity", "error"] == 1


def test_paths(tmp_path, monkeypatch):
    monkeypatch.delenv("CLAIMLOOM_CORPUS", raising=False)
    with pytest.raises(corpus.CorpusError):
        corpus.corpus_dir([str(tmp_path)])
    corpus_of(tmp_path, [RECORD])
    assert corpus.corpus_dir(["/nowhere", str(tmp_path)]) == str(tmp_path)
    (tmp_path / ".env").write_text("# c\nCLAIMLOOM_CORPUS='there'\nBROKEN\n")
    corpus.read_env(str(tmp_path / ".env"))
    assert corpus.corpus_dir([]) == "there"
    (tmp_path / "syn.txt").write_text("# comment\ntire, tyre\n\nrim => felloe # x\n")
    assert files.read_synonyms(str(tmp_path / "syn.txt")) == [["tire", "tyre"], ["rim", "felloe"]]
    assert files.read_synonyms(str(tmp_path / "none.txt")) == []


def test_eval_set_round_trip(spark, tmp_path):
    q = spark.createDataFrame([("q1", "a text", "P1", "title", {"r1": 3})], "query_id string, text string, source_patent_id string, query_type string, qrels map<string,int>")
    files.write_eval_set(q, {"seed": 13}, str(tmp_path / "e.jsonl"))
    again, notes = files.read_eval_set(spark, str(tmp_path / "e.jsonl"))
    assert notes == {"seed": 13} and again.collect() == q.collect()


def test_record_sinks(spark, tmp_path):
    r = spark.createDataFrame([("a", "claim", 1), ("b", "summary", None)], "record_id string, record_type string, claim_number int")
    files.write_records(r, str(tmp_path / "j"))
    assert any("claim_number" not in line.value for line in spark.read.text(str(tmp_path / "j")).collect())
    files.write_record_table(r, str(tmp_path / "t"))
    files.write_record_table(r.limit(0), str(tmp_path / "t"), "ignore")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    new = spark.createDataFrame([("a", "claim", 7), ("c", "claim", 8)], r.schema)
    assert {x.record_id: x.claim_number for x in files.upsert_records(r, new).collect()} == {"a": 7, "b": None, "c": 8}


def incoming(spark, *rows, version="1"):
    return spark.createDataFrame([(p, "f", h, version, None) for p, h in rows], "patent_id string, source_file string, source_hash string, parser_version string, embedding_model string")


def test_job_life(spark):
    jobs = J.enqueue(spark.createDataFrame([], J.JOB), incoming(spark, ("P1", "a"), ("P2", "b"), ("", "x")), 1.0)
    assert {r.patent_id for r in jobs.collect()} == {"P1", "P2"}
    jobs = J.claim(jobs, "w", 1, 2.0)
    assert [(r.patent_id, r.status) for r in jobs.where("worker_id = 'w'").collect()] == [("P1", "VALIDATING")]
    assert J.claimable(jobs, 9).count() == 1
    jobs = J.advance(jobs, ["P1"], "INDEXING", 3.0)
    assert J.stale(jobs, 300.0).count() == 0 and J.stale(jobs, 303.0).count() == 1
    assert J.reclaim_stale(jobs, 400.0).where("status = 'PENDING'").count() == 2
    out = lambda n, e: spark.createDataFrame([("P1", n, e)], "patent_id string, record_count int, error string")
    done = J.apply_outcomes(jobs, out(10, None), 4.0)
    s = J.summary(done).first()
    assert (s.total, s.completed, s.percent_complete, s.records_indexed) == (2, 1, 50.0, 10)
    same = J.enqueue_decisions(done, incoming(spark, ("P1", "a"), ("P2", "b")))
    assert {r.patent_id: r.queue for r in same.collect()} == {"P1": False, "P2": True}
    assert J.enqueue_decisions(done, incoming(spark, ("P1", "a"), version="2")).first().queue
    bad = jobs
    for i in range(3):
        bad = J.apply_outcomes(bad, out(0, "E" * 5000), 5.0 + i)
    row = bad.where("patent_id = 'P1'").first()
    assert (row.status, row.retry_count, len(row.last_error)) == ("FAILED", 3, 2000)
    assert J.failures(bad).count() == 1 and {r.status: r.jobs for r in J.counts(bad).collect()} == {"FAILED": 1, "PENDING": 1}
    again = J.enqueue(bad, incoming(spark, ("P1", "new")), 9.0)
    assert J.claimable(again, 9).count() == 2  # a changed patent starts anew
    same = J.enqueue(bad, incoming(spark, ("P1", "a")), 9.0)
    assert J.get(same, "P1").first().status == "FAILED" and J.claimable(J.requeue_failed(same, 9.0), 9).count() == 2


def test_ingest_is_idempotent(spark, tmp_path):
    lists = [[RECORD | {"doc_number": f"P{f}{i}"} for i in range(3)] for f in range(6)]
    patents, _ = corpus.load_corpus(spark, corpus_of(tmp_path, *lists))
    table, made = ingest.JobTable(spark, str(tmp_path / "jobs")), []
    sink = lambda r: made.append(r.count())
    assert ingest.ingest_batch(patents, table, sink, "1") == (18, 0)
    assert ingest.ingest_batch(patents, table, sink, "1") == (0, 18)
    edited = patents.withColumn("abstract", F.when(F.col("patent_id") == "P00", "Other").otherwise(F.col("abstract")))
    assert ingest.ingest_batch(edited, table, sink, "1") == (1, 17)
    assert ingest.ingest_batch(edited, table, sink, "2") == (18, 0)
    assert J.summary(table.read()).first().completed == 18 and len(made) == 3

    def broken(_):
        raise OSError("disk")

    for retries in (1, 2, 3):
        with pytest.raises(OSError):
            ingest.ingest_batch(edited, table, broken, "3")
        rows = table.read().where("last_error LIKE 'OSError%'").collect()
        assert {(r.status, r.retry_count) for r in rows} == {("PENDING" if retries < 3 else "FAILED", retries)} and len(rows) == 18
    assert ingest.ingest_batch(edited, table, sink, "3") == (0, 18)  # failed for good: nothing is queued
    table.write(J.requeue_failed(table.read(), 1.0))
    assert ingest.drain(edited, table, sink).completed == 18


def test_one_bad_patent_fails_alone(spark, tmp_path):
    row = dict(title="T", abstract="An axle is held.", classification_raw="B60", description_paragraphs=["Text."], bibtex="", filename="", has_description=True, source_file="f")
    rows = [row | {"patent_id": "good", "claims_raw": ["1. A thing."]}, row | {"patent_id": "bad", "claims_raw": [" "]}, row | {"patent_id": "gone", "claims_raw": ["1. A thing."]}]
    patents = spark.createDataFrame(rows, "patent_id string, title string, abstract string, classification_raw string, claims_raw array<string>, description_paragraphs array<string>, bibtex string, source_file string, filename string, has_description boolean")
    table, records = ingest.JobTable(spark, str(tmp_path / "jobs")), ingest.RecordTable(spark, str(tmp_path / "records"))
    table.update(J.enqueue(table.read(), ingest.patents_hash(patents).selectExpr("*", "'1' AS parser_version", "CAST(NULL AS string) AS embedding_model"), 1.0))
    result = ingest.drain(patents.where("patent_id <> 'gone'"), table, records.append, batch=2)
    assert (result.completed, result.failed, result.processed, result.records) == (1, 2, 7, records.read().count())
    got = {r.patent_id: r for r in table.read().collect()}
    assert got["good"].status == "COMPLETED" and got["good"].worker_id is None and got["good"].record_count == result.records
    assert got["bad"].status == "FAILED" and "no non-blank claims" in got["bad"].last_error and got["bad"].retry_count == 3
    assert "not found" in got["gone"].last_error
    assert ingest.drain(patents, table, records.append).processed == 0


def test_updated_patents_replace_their_records(spark, tmp_path):
    first = [RECORD | {"doc_number": f"P{i}", "claims": ["1 . One.", "2 . Two.", "3 . Three."]} for i in range(3)]
    patents, _ = corpus.load_corpus(spark, corpus_of(tmp_path, first))
    table, records = ingest.JobTable(spark, str(tmp_path / "jobs")), ingest.RecordTable(spark, str(tmp_path / "records"))
    ingest.ingest_batch(patents, table, records.append, "1")
    before = records.read().count()
    changed = patents.withColumn("claims_raw", F.when(F.col("patent_id") == "P1", F.array(F.lit("1 . Other."))).otherwise(F.col("claims_raw")))
    assert ingest.ingest_batch(changed, table, records.append, "1") == (1, 2)
    now = records.read()
    assert now.count() == before - 2 and now.where("patent_id = 'P1' AND record_type = 'claim'").select("text").collect()[0].text == "1 . Other."
    assert now.select("record_id").distinct().count() == now.count()


def test_the_latest_of_several_deliveries_counts(spark, tmp_path):
    base = dict(title="T", classification_raw="B60", claims_raw=["1. A thing."], description_paragraphs=["Text."], bibtex="", filename="", has_description=True, source_file="f")
    rows = [base | {"patent_id": "P", "abstract": a, "ingested_at": t} for a, t in (("old", 1), ("new", 3), ("middle", 2))]
    patents = spark.createDataFrame(rows, "patent_id string, title string, abstract string, classification_raw string, claims_raw array<string>, description_paragraphs array<string>, bibtex string, source_file string, filename string, has_description boolean, ingested_at int")
    table, records = ingest.JobTable(spark, str(tmp_path / "jobs")), ingest.RecordTable(spark, str(tmp_path / "records"))
    assert ingest.ingest_batch(patents, table, records.append, "1") == (1, 0)
    assert records.read().where("record_type = 'abstract'").first().text == "new"
    assert ingest.ingest_batch(patents.where("ingested_at = 3"), table, records.append, "1") == (0, 1)


def test_job_table_versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest.JobTable, "COMPACT", 3)
    table = ingest.JobTable(spark, str(tmp_path / "jobs"))
    assert table.read().count() == 0
    table.write(J.enqueue(table.read(), incoming(spark, *[(f"P{i}", "a") for i in range(9)]), 1.0))
    for i in range(8):
        table.update(table.read().where(f"patent_id = 'P{i}'").withColumn("status", F.lit("COMPLETED")).withColumn("updated_at", F.lit(2.0 + i)))
    assert {r.status: r.jobs for r in J.counts(table.read()).collect()} == {"COMPLETED": 8, "PENDING": 1}
    assert len(table.names()) <= 9 and sum(n.endswith("-all") for n in table.names()) <= 2


def test_streams(spark, tmp_path, sf):
    lists = [[RECORD | {"doc_number": f"P{i}"} for i in range(4)]]
    patents, _ = corpus.load_corpus(spark, corpus_of(tmp_path, *lists))
    patents.write.parquet(str(tmp_path / "in"))
    q = ingest.ingest_stream(spark, str(tmp_path / "in"), patents.schema, str(tmp_path / "jobs"), str(tmp_path / "out"), str(tmp_path / "check"), "1")
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select("patent_id").distinct().count() == 4
    events = spark.read.parquet(sf + "/events.parquet")
    (tmp_path / "ev").mkdir()
    events.write.mode("overwrite").parquet(str(tmp_path / "ev"))
    stream = ingest.event_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")))
    s = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    s.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("events")).first()[0] == events.count() == ingest.event_counts(events).agg(F.sum("events")).first()[0]
    hits = spark.read.parquet(sf + "/hits.parquet").where("logged_at IS NOT NULL")
    hits.write.parquet(str(tmp_path / "h"))
    d = ingest.latest_hits(spark.readStream.schema(hits.schema).parquet(str(tmp_path / "h")), "3650 days").writeStream.format("memory").queryName("dh").outputMode("append").trigger(availableNow=True).start()
    d.awaitTermination(120)
    assert spark.table("dh").count() == hits.select("run_id", "record_id").distinct().count()
