"""Sources, sinks, streams and staging."""

import json

import pytest

from tonelake import storage, streaming
from tonelake.sources import files, sinks


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "A"), (2, "B")], "id int, ticker string")
    sinks.by_company(df, path)
    sinks.by_company(spark.createDataFrame([(3, "B")], "id int, ticker string"), path)
    assert sorted((r["id"], r["ticker"]) for r in spark.read.parquet(path).collect()) == [(1, "A"), (3, "B")]
    up = str(tmp_path / "u")
    sinks.upsert_table(spark, up, df, "id")
    sinks.upsert_table(spark, up, spark.createDataFrame([(2, "C")], "id int, ticker string"), "id")
    sinks.delete_company(spark, up, "A")
    assert [tuple(r) for r in spark.read.parquet(up).collect()] == [(2, "C")]


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<html><head><title>t</title></head><body><p>One</p><script>x</script><p>Two &amp; three</p></body></html>")
    assert files.texts(spark, str(tmp_path / "a.html")).first()["text"] == "One\nTwo & three"
    (tmp_path / "r.json").write_text(json.dumps([{"id": 1, "x": "a"}, {"id": "no", "x": "b"}]))
    assert [r["id"] for r in files.json_rows(spark, str(tmp_path / "r.json"), "id int, x string").collect()] == [1]
    (tmp_path / "f.json").write_text(json.dumps({"facts": {"Revenue": {"units": {"USD": [{"end": "2024-03-31", "val": 5.0, "form": "10-Q", "accn": "x"}]}}}}))
    assert files.reported_facts(spark, str(tmp_path / "f.json")).first()["value"] == 5.0
    nested = spark.createDataFrame([((1, (2,)),)], "a struct<b: int, c: struct<d: int>>")
    assert files.flatten(nested).columns == ["a.b", "a.c.d"]


def test_stage_survives_its_source(spark):
    df = storage.stage(spark.range(5).toDF("x"))
    assert df.count() == 5 and storage.shared_dir(spark)
    assert storage.small_enough(df, 5) and not storage.small_enough(df, 4)


def test_stream_equals_batch(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(source)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streaming.windowed_counts(streaming.arriving(spark, str(tmp_path / "in"), batch.schema, 1), "ts", "event_type", "value", late="60 days")
    q = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert spark.table("counted").agg({"n": "sum"}).first()[0] == batch.count()
    s = streaming.arriving(spark, str(tmp_path / "in"), batch.schema, 1).select("event_type", "event_id")
    w = streaming.keep_newest(s, str(tmp_path / "out"), "event_type", str(tmp_path / "c2"), "event_id").trigger(availableNow=True).start()
    w.awaitTermination()
    newest = {tuple(r) for r in batch.groupBy("event_type").agg({"event_id": "max"}).collect()}
    assert {(r["event_type"], r["event_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == newest


def test_upsert_keeps_the_newest_row_and_survives_failures(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "id int, part string, at int, x string")
    sinks.upsert_table(spark, path, rows((1, "a", 5, "new"), (2, "b", 5, "new"), (None, "a", 1, "null")), "id", "at", "part")
    untouched = {f.name for f in (tmp_path / "t" / "part=b").iterdir()}
    sinks.upsert_table(spark, path, rows((1, "a", 4, "late"), (3, "a", 1, "first"), (None, "a", 2, "newer")), "id", "at", "part")
    got = {(r["id"], r["x"]) for r in spark.read.parquet(path).collect()}
    assert got == {(1, "new"), (2, "new"), (3, "first"), (None, "newer")}
    assert {f.name for f in (tmp_path / "t" / "part=b").iterdir()} == untouched
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"no footer here")
    with pytest.raises(Exception):
        sinks.upsert_table(spark, str(broken), rows((1, "a", 1, "x")), "id", "at")
    assert (broken / "part-0.parquet").read_bytes() == b"no footer here"
    (tmp_path / "t").rename(tmp_path / "t.old-1")  # cut off between the renames
    assert sinks.table_exists(spark, path) and spark.read.parquet(path).count() == 4
    assert not sinks.table_exists(spark, str(tmp_path / "none"))


def test_shared_folder_is_required_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        def __init__(self, master):
            self.master = master

        def getCheckpointDir(self):
            return None

        def setCheckpointDir(self, _):
            pass

    class Session:
        def __init__(self, master):
            self.conf, self.sparkContext = Conf(), Context(master)

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            storage.shared_dir(Session(master))
    assert storage.shared_dir(Session("local[2]")).startswith("file:///")


def test_scratch_deletes_what_was_staged(spark):
    with storage.scratch(spark):
        one = storage.stage(spark.range(3).toDF("x"))
        assert one.count() == 3
    fs, p = storage.hadoop_path(spark, one._staged_at)
    assert not fs.exists(p)
    other = storage.stage(spark.range(3).toDF("x"))
    storage.unstage(other)
    assert not fs.exists(storage.hadoop_path(spark, other._staged_at)[1])


def test_pipeline(spark, tmp_path):
    from tonelake.operators import models
    from tonelake.plans import pipeline

    folder, out = "/root/testdata/sf0.001", str(tmp_path / "p")
    pipeline.ingest(spark, folder, out)
    pipeline.embed(spark, out)
    pipeline.analyse(spark, folder, out, models.tone_model(lambda: lambda texts: [(0.2, 0.7, 0.1) for _ in texts]))
    assert spark.read.parquet(f"{out}/quarters").where("net_sentiment_score > -0.49").isEmpty()
    scores = spark.read.parquet(f"{out}/scores")
    assert scores.count() > 0 and pipeline.wanted(scores, scores).isEmpty()


def test_pipeline_reads_filings_and_calls(spark, tmp_path):
    from datetime import date, datetime

    from tonelake.plans import pipeline

    told = "Management expects revenue of $7 million. " * 400
    filing = "Item 1A. Risk Factors " + "x " * 200 + "Item 2. Management's Discussion and Analysis " + told + "The tail of the filing."
    f = spark.createDataFrame([("a", " abc", "10-Q", None, None, date(2024, 5, 9), filing, datetime(2024, 5, 9)), ("a", "ABC", "10-Q", None, None, date(2024, 5, 9), "later load", datetime(2024, 6, 9))], "accession_number string, ticker string, filing_type string, quarter string, year int, period_of_report date, raw_text string, loaded_at timestamp")
    c = spark.createDataFrame([(1, "ABC", "Q2", 2024, "Jane Doe -- CEO: Good day to all.\nJohn Roe -- Analyst: Thank you, my question of today is on margins.\nJane Doe -- CEO: They were fine.", None), (2, "ABC", "Q2", 2024, "no label, yet text of a call", None)], "transcript_id long, ticker string, quarter string, year int, raw_text string, loaded_at timestamp")
    filings, calls = pipeline.filing_chunks(f), pipeline.call_chunks(c)
    assert filings.where("section = 'risk_factors'").count() == 1 and filings.where("section = 'mda' and quarter = 'Q2' and year = 2024 and ticker = 'ABC'").count() > 5
    assert filings.where("text like '%The tail of the filing.'").count() == 1 and filings.where("text like '%later load%'").isEmpty()
    assert sorted((r["section"], r["text"]) for r in calls.collect()) == [("prepared_remarks", "Good day to all."), ("prepared_remarks", "no label, yet text of a call"), ("qa", "Q: Thank you, my question of today is on margins.\n\nA: They were fine.")]
    assert filings.unionByName(calls).select("chunk_id").distinct().count() == filings.count() + 3
    found = pipeline.found_guidance(filings.selectExpr("*", "true as contains_numbers"))
    assert {(r["ticker"], r["quarter"], r["metric"], r["value_low"]) for r in found.collect()} == {("ABC", "Q2", "revenue", 7e6)}


def test_failing_model_is_neutral(spark):
    from pyspark.sql import functions as F

    from tonelake.operators import models

    def broken():
        def run(texts):
            raise RuntimeError("no model")

        return run

    df = spark.createDataFrame([("a",), (None,)], "text string").select(models.tone_model(broken)(F.col("text")).alias("s"))
    assert [tuple(r.s) for r in df.collect()] == [(0.0, 0.0, 1.0)] * 2


def test_one_of_each(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "w"), ("a", 1, None), ("b", 2, None), (None, 3, "y"), ("c", None, "z"), ("d", 4, "q")], "k string, j int, t string")
    assert sorted(map(tuple, storage.one_of_each(df, ["k", "j"], "t").collect())) == [("a", 1, "w"), ("b", 2, None), ("d", 4, "q")]
    assert storage.one_of_each(df.limit(0), ["k"], "t").count() == 0


def test_runs_and_vectors(spark, tmp_path):
    from tonelake.operators import evaluation

    runs = str(tmp_path / "runs")
    for i, t in enumerate(("A", "B", "A")):
        sinks.start_run(spark, runs, f"r{i}", {"ticker": t}, f"2024-01-0{i + 1} 00:00:00")
    log = spark.read.parquet(runs).selectExpr("*", "map('n', 1) as metrics")
    assert [r["run_id"] for r in evaluation.recent_runs(log, 2).collect()] == ["r2", "r1"] and [r["run_id"] for r in evaluation.recent_runs(log, 9, "A").collect()] == ["r2", "r0"]
    path = str(tmp_path / "v")
    chunks = spark.createDataFrame([(1, "a b"), (2, "c")], "chunk_id long, text string")
    assert sinks.embed_and_store(spark, path, chunks) == 2
    assert sinks.embed_and_store(spark, path, spark.createDataFrame([(2, "changed"), (3, "new")], "chunk_id long, text string")) == 2
    assert sorted((r["chunk_id"], r["text"]) for r in spark.read.parquet(path).collect()) == [(1, "a b"), (2, "changed"), (3, "new")]
    log_path = str(tmp_path / "m")
    sinks.append_metrics(spark.createDataFrame([("r1", "x", 1)], "run_id string, metric string, value int"), log_path)
    sinks.export_json(spark.read.parquet(log_path), str(tmp_path / "j"))
    sinks.export_csv(spark.read.parquet(log_path), str(tmp_path / "c"))
    assert files.csv_rows(spark, str(tmp_path / "c"), "run_id string, metric string, value double").first()["value"] == 1.0


def test_parsed_pages(spark):
    from pyspark.sql import functions as F

    page = "<html><head><title>x</title></head><body>" + "<p>line</p>" * 12 + "<script>gone</script></body></html>"
    df = spark.createDataFrame([(1, page), (2, "plain <b>text</b>"), (3, ""), (4, None)], "id int, t string")
    got = {r["id"]: r["x"] for r in df.select("id", files.parsed(F.col("t")).alias("x")).collect()}
    assert got == {1: "\n".join(["line"] * 12), 2: "plain text", 3: "", 4: None}


def test_calls_from_pages(spark):
    from tonelake.operators import articles

    body = "".join(f"<p>{p}</p>" for p in ("<b>Ann Lee -- CEO:</b> We did very well this year.", "a", "b", "<b>Bo Ray -- Analyst:</b> What about the costs of it?", "c"))
    rows = [(1, f"<meta property='article:published_time' content='2024-05-02T10:00'><article class='a'>{body}</article>", "Q1", 2024), (2, f"<article class='a'>{body}</article>", "Q3", 2024), (3, "<p>x</p>", "Q1", 2024)]
    got = articles.calls(spark.createDataFrame(rows, "id int, html string, quarter string, year int"), "id").orderBy("id").collect()
    assert [(r["id"], str(r["call_date"])) for r in got] == [(1, "2024-05-02"), (2, "2024-07-01")]
    assert got[0]["raw_text"] == "Ann Lee: We did very well this year. a b\n\nBo Ray: What about the costs of it? c"


def test_running_tone_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from tonelake.operators import sentiment
    from tonelake.sources import tables

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scored = sentiment.scored(tables.chunks(d)).select("chunk_id", "ticker", "quarter", "year", "words", "positive", "negative").withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    scored.unionByName(scored.limit(5)).repartition(3).write.parquet(str(tmp_path / "in"))  # five chunks arrive twice
    stream = streaming.quarter_tone(streaming.arriving(spark, str(tmp_path / "in"), scored.schema, 1), "at")
    q = stream.writeStream.format("memory").queryName("tones").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    key = lambda r: (r["ticker"], r["quarter"], r["year"])
    running = {key(r): (round(r["net_sentiment_score"], 9), r["chunk_count"]) for r in spark.table("tones").collect()}
    w = F.col("words")
    batch = scored.groupBy("ticker", "quarter", "year").agg((F.sum((F.col("positive") - F.col("negative")) * w) / F.sum(w)).alias("t"), F.count("*").alias("n"))
    assert running == {key(r): (round(r["t"], 9), r["n"]) for r in batch.collect()}
