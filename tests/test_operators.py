"""Operators on small literal frames."""

from datetime import date

from conftest import frame_rows
from pyspark.sql import functions as F

from tonelake.functions import dates as D
from tonelake.functions import labels, numbers
from tonelake.functions import text as T
from tonelake.functions import prompts
from tonelake.operators import articles, backtest, chunking, client, drift, evaluation, guidance, pairs, qa, quality, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def quarters(spark, net, hedge, spec):
    rows = [("A", f"Q{i % 4 + 1}", 2023 + i // 4, n, h, s) for i, (n, h, s) in enumerate(zip(net, hedge, spec))]
    return spark.createDataFrame(rows, "ticker string, quarter string, year int, net_sentiment_score double, hedging_score double, specificity_score double")


def test_drift_alerts(spark):
    red = quarters(spark, [0.40, 0.25, 0.05, -0.15], [5.0, 6.5, 7.8, 9.2], [0.80, 0.72, 0.60, 0.48])
    assert drift.drift_alerts(red).first()["alert_level"] == "RED"
    assert drift.drift_scores(red).first()["drift_score"] < 0
    green = quarters(spark, [0.1, 0.3, 0.5], [5.0, 5.0, 5.0], [0.5, 0.5, 0.5])
    assert drift.drift_alerts(green).first()["alert_level"] == "GREEN" and drift.drift_scores(green).first()[1] > 0
    assert drift.drift_scores(quarters(spark, [0.1], [1.0], [1.0])).first()[1] == 0.0
    assert drift.drift_trends(red).first()["sentiment_trend"] == [0.40, 0.25, 0.05, -0.15]


def test_numbers(spark):
    assert abs(one(spark, numbers.accuracy(F.lit(1.55), F.lit(1.60))) - (1 - 0.05 / 1.6)) < 1e-12
    assert one(spark, numbers.accuracy(F.lit(5.0), F.lit(0.0))) == 0.5
    assert one(spark, numbers.clamp(F.lit(None).cast("double"), -1, 1)) is None
    assert [one(spark, labels.bias_label(F.lit(x))) for x in (-0.15, -0.02, 0.07, 0.15, 0.35)] == ["sandbagging", "accurate", "slightly optimistic", "optimistic", "aggressively optimistic"]
    assert one(spark, numbers.parse_financial_value(F.lit("about -$1,250.5 million"))) == -1250.5e6
    assert one(spark, numbers.parse_financial_value(F.lit("5 to 7"))) == 5.0
    assert one(spark, numbers.accruals_component(F.lit(0.0))) == 0.0
    assert abs(sum(one(spark, numbers.softmax(F.array(F.lit(2.5), F.lit(0.5), F.lit(0.3))))) - 1) < 1e-12
    assert one(spark, numbers.mean_of_present(F.lit(0.95), F.lit(0.90), F.lit(0.85), F.lit(0.88))) == 0.895


def test_dates(spark):
    day = lambda s: F.lit(s).cast("date")
    assert one(spark, D.next_trading_day(day("2024-10-05"))) == date(2024, 10, 7) == one(spark, D.next_trading_day(day("2024-10-07")))
    assert one(spark, D.earnings_date(F.lit("Q3"), F.lit(2024))) == date(2024, 10, 15) and one(spark, D.earnings_date(F.lit("Q4"), F.lit(2023))) == date(2024, 1, 15)
    assert one(spark, D.add_trading_days(day("2024-01-05"), 1)) == date(2024, 1, 8)
    assert one(spark, D.weekdays_between(day("2024-01-08"), day("2024-02-05"))) == 21
    assert one(spark, D.quarters_between(F.lit("Q3"), F.lit(2023), F.lit("Q1"), F.lit(2024))) == ["Q3 2023", "Q4 2023", "Q1 2024"]
    assert one(spark, D.past_quarters(day("2024-05-10"), 3)) == ["Q1 2024", "Q4 2023", "Q3 2023"]


def test_text(spark):
    assert one(spark, T.sentences(F.lit("Dr. Smith spoke. Sales rose 5%. He left."))) == ["Dr. Smith spoke.", "Sales rose 5%.", "He left."]
    inline = F.lit("<p>a&nbsp;&amp; <ix:nonFraction x='1'>5</ix:nonFraction></p>")
    assert one(spark, T.flat_html(inline)) == "a &" and one(spark, T.flat_html(inline, keep_inline=True)) == "a & 5"
    assert one(spark, T.clean_whitespace(F.lit("a  b\n-----\n\n\n\n12\nc"))) == "a b\n\nc"
    assert one(spark, T.truncate_words(F.lit("a b c"), 2)) == "a b…"
    assert one(spark, T.json_reply(F.lit('```json\n{"score": 0.5}\n```'), "score double"))["score"] == 0.5
    assert one(spark, T.speaker_role(F.lit("Jane Doe, Chief Financial Officer"))) == "CFO"


def test_guidance(spark):
    texts = spark.createDataFrame([(1, "For fiscal 2025 we expect revenue of $1.2 to $1.3 billion, and capex of 300 million."), (2, "We guide diluted EPS of $1.60 to $1.50"), (3, "nothing here"), (4, None), (5, "Expected growth of 5% to 7%, gross margin of 41.5%")], "id long, text string")
    got = sorted((r["id"], r["metric"], r["low"], r["high"], r["unit"], r["confidence"], r["fiscal_period"], r["is_explicit"]) for r in guidance.extract_guidance(texts, "id").collect())
    assert got == [(1, "capex", 3e8, None, "USD", 0.8, "fiscal 2025", False), (2, "EPS", 1.5, 1.6, "USD/share", 0.85, "", True), (5, "growth", 5.0, 7.0, "%", 0.75, "", True), (5, "margin", 41.5, None, "%", 0.8, "", False)]
    # the first number has no magnitude of its own, and 1.2 dollars are no revenue
    assert guidance.extract_guidance(texts.limit(0), "id").count() == 0
    g = spark.createDataFrame([(1, "A", "Q4", 2023, "EPS", 1.0, 2.0, 0.5), (2, "A", "Q1", 2023, "EPS", None, None, 0.5)], "guidance_id long, ticker string, quarter string, year int, metric string, value_low double, value_high double, confidence_score double")
    f = spark.createDataFrame([("x", "A", "Q1", 2024, False, date(2024, 5, 1), 1.5, 1.0, 1.0, 0.4), ("y", "A", "Q1", 2024, True, date(2024, 6, 1), 3.0, 1.0, 1.0, 0.4)], "accession_number string, ticker string, quarter string, year int, is_amendment boolean, filed_date date, eps_diluted double, revenue double, capex double, gross_margin double")
    got = {r["guidance_id"]: (r["actual"], r["accuracy"]) for r in guidance.match_guidance(g, f).collect()}
    assert got == {1: (3.0, 0.5), 2: (None, None)}


def test_every_amount_is_extracted(spark):
    texts = spark.createDataFrame([(1, "We expect revenue of $5 million. We expect revenue of $7 million, and expect revenue of $7.0 million."), (2, "EPS guidance of $5000.0 was a slip. EPS guidance of $2.50 is right."), (3, "We expect revenue of $1,200 million.")], "id long, text string")
    got = sorted((r["id"], r["metric"], r["low"]) for r in guidance.extract_guidance(texts, "id").collect())
    assert got == [(1, "revenue", 5e6), (1, "revenue", 7e6), (2, "EPS", 2.5)]
    assert [r["low"] for r in guidance.extract_guidance(texts.where("id = 3"), "id", grouped=True).collect()] == [1.2e9]
    near = guidance.extract_guidance(texts.where("id = 2"), "id").first()
    assert near["raw_text"] == "$5000.0 was a slip. EPS guidance of $2.50 is right."


def test_prices_and_trades(spark):
    p = spark.createDataFrame([("A", date(2024, 1, 8), 101.0, 102.0), ("A", date(2024, 2, 5), 110.0, 121.2)], "ticker string, dt date, open double, close double")
    d = spark.createDataFrame([("A", date(2024, 1, 6)), ("A", date(2024, 1, 12))], "ticker string, day date")
    assert frame_rows(backtest.price_on_or_after(d, p, "open")) == [("A", date(2024, 1, 12), None), ("A", date(2024, 1, 6), 101.0)]
    s = spark.createDataFrame([("A", "Q4", 2023, 0.5, 1), ("A", "Q4", 2023, 0.1, 2), ("B", "Q4", 2023, -0.4, 1)], "ticker string, quarter string, year int, composite_score double, computed_at int")
    assert [r["ticker"] for r in backtest.signals(s, None).collect()] == ["B"]  # the newer neutral run hides the older signal


def test_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 16))
    rows = [(i, [float(v) for v in base[i % 12] + 0.15 * rng.normal(size=16)]) for i in range(1500)] + [(9000, None), (9001, [0.0] * 16)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    q = v.where("id % 20 = 0")
    exact, found = vectors.top_k(v, q, "id", "v", 10, size=256).cache(), vectors.indexed_top_k(v, q, "id", "v", 10, cells=16, probes=6)
    assert exact.count() == 750 and vectors.recall(found, exact) >= 0.9
    m = np.array([r[1] for r in rows[:1500]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    best = np.argsort(-(m[40] @ m.T))[1:11]
    assert [r["neighbour_id"] for r in exact.where("query_id = 40").orderBy("rank").collect()] == best.tolist()
    assert vectors.indexed_top_k(v.limit(0), q, "id", "v").count() == 0


def test_index_recall_on_tables(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = v.where("vec_id % 20 = 0")
    assert vectors.recall(vectors.indexed_top_k(v, q, "vec_id", "embedding"), vectors.top_k(v, q, "vec_id", "embedding")) >= 0.9


def test_pairs_and_upsert(spark):
    side = lambda i: ("transcript", "prepared_remarks") if i % 2 else ("10-Q", "mda")
    c = spark.createDataFrame([("A", "Q1", 2024, i, *side(i)) for i in range(60)] + [("A", "Q1", 2024, 60, "8-K", "mda"), ("A", "Q1", 2024, 61, "transcript", "qa")], "ticker string, quarter string, year int, chunk_id long, form string, section string")
    whole = sorted((a, b) for a in range(1, 60, 2) for b in range(0, 60, 2))[:100]
    assert sorted((r["a"], r["b"]) for r in pairs.intra_period_pairs(c, most=100).collect()) == whole
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string"), spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "id int, x string")
    assert frame_rows(vectors.upsert(old, new, "id")) == [(1, "a"), (2, "c"), (3, "e")]


def test_every_pair_is_scored(spark):
    from tonelake.plans import pipeline

    texts = lambda i: "record strong growth" if i % 2 else "loss decline weak" if i == 58 else "plain words"
    side = lambda i: ("transcript", "guidance") if i % 2 else ("10-K", "mda")
    c = spark.createDataFrame([("A", "Q1", 2024, i, *side(i), texts(i), 3, [1.0, 0.0]) for i in range(60)], "ticker string, quarter string, year int, chunk_id long, form string, section string, text string, words int, embedding array<double>")
    assert pairs.intra_period_pairs(c).count() == 900
    # The only report that contradicts has the last id: its pairs with late call chunks lie beyond the first 500.
    assert sorted((r["a"], r["b"]) for r in pipeline.contradictions(c).collect()) == [(a, 58) for a in range(1, 60, 2)]


def test_pairs_are_judged_by_whole_texts(spark):
    from tonelake.operators import models

    start = "plain words " * 60
    s = one(spark, models.opposition(F.lit(start + "record strong growth"), F.lit(start + "loss decline weak")))
    assert s["contradiction"] == 0.9
    assert one(spark, models.opposition(F.lit("strong " + start + "loss decline weak"), F.lit("loss")))["entailment"] == 0.9


def test_chunking(spark):
    t = spark.createDataFrame([(1, " ".join(f"Sentence number {i} says a few plain words." for i in range(200)))], "id int, text string")
    rows = chunking.windows(t, "id").orderBy("chunk_index").collect()
    assert len(rows) > 2 and rows[0]["total_chunks"] == len(rows)
    assert rows[1]["chunk"].split(". ")[0] in rows[0]["chunk"]
    turns = spark.createDataFrame([(1, 0, "Operator", "x" * 60), (1, 1, "Analyst", "q" * 60), (1, 2, "CEO", "a" * 60), (1, 3, "CFO", "b" * 60)], "id int, turn_index int, role string, body string")
    assert [r["speaker"] for r in chunking.question_pairs(turns, "id").orderBy("turn_index").collect()] == ["QA_PAIR", "CFO"]
    lone = chunking.question_pairs(turns.where("role = 'Analyst'"), "id").collect()
    assert len(lone) == 1 and lone[0]["body"].endswith("A:")
    s = spark.createDataFrame([("f", "Item 1A. Risk Factors " + "x " * 200 + "Item 2. Management's Discussion and Analysis " + "y " * 200), ("g", "no heading")], "id string, text string")
    assert sorted((r["id"], r["section"]) for r in chunking.sections(s, "id").collect()) == [("f", "mda"), ("f", "risk_factors"), ("g", "mda")]


def test_chunks_by_form(spark):
    report = "Item 1A. Risk Factors " + "We may lose. " * 60 + "Item 2. Management's Discussion and Analysis " + "Sales fell. " * 60
    rows = [("a", "X", "10-Q", "Q1", 2024, report), ("b", "X", "8-K", "Q1", 2024, "Sales rose by $5 million. " * 20), ("c", "X", None, "Q1", 2024, "A letter. " * 30), ("d", "X", "10-K", "Q4", 2024, "")]
    got = chunking.filing_chunks(spark.createDataFrame(rows, "doc string, ticker string, form string, quarter string, year int, text string"))
    kinds = {(r["doc"], r["section"], r["strategy"]) for r in got.collect()}
    assert kinds == {("a", "risk_factors", "section_aware"), ("a", "mda", "section_aware"), ("b", "press_release", "semantic"), ("c", "unknown", "fixed_overlap")}
    again = chunking.filing_chunks(spark.createDataFrame(rows[::-1], "doc string, ticker string, form string, quarter string, year int, text string"))
    assert {r["chunk_id"] for r in got.collect()} == {r["chunk_id"] for r in again.collect()} and all(r["contains_numbers"] == (r["doc"] == "b") for r in got.collect())
    turns = [("t", "X", "Q1", 2024, s, i, sp, role, body) for s, i, sp, role, body in [("prepared_remarks", 0, "Op", "Operator", "welcome to all of you"), ("prepared_remarks", 1, "Ann", "CEO", "We did well in the year."), ("qa", 2, "Bo", "Analyst", "What about the margins of the year?"), ("qa", 3, "Ann", "CEO", "They were fine, we expect more of it."), ("qa", 4, "Cy", "unknown", "This turn is left out, whatever it says.")]]
    calls = chunking.call_chunks(spark.createDataFrame(turns, "doc string, ticker string, quarter string, year int, section string, turn_index int, speaker string, role string, body string"))
    assert [(r["section"], r["speaker"], r["chunk_index"], r["total_chunks"]) for r in calls.orderBy("chunk_index").collect()] == [("prepared_remarks", "CEO", 0, 2), ("guidance", "QA_PAIR", 1, 2)]


def test_marked_turns(spark):
    df = spark.createDataFrame([(1, "Ann Lee -- CEO: We did very well.\nQuestion-and-Answer Session\nBo Ray -- Analyst: What about the costs?\n12: no name"), (2, "No label, but some text"), (3, ""), (4, None)], "id int, text string")
    got = sorted((r["id"], r["section"], r["turn_index"], r["speaker"], r["role"]) for r in chunking.marked_turns(df, "id").collect())
    assert got == [(1, "prepared_remarks", 0, "Ann Lee", "CEO"), (1, "qa", 0, "Bo Ray", "Analyst"), (2, "prepared_remarks", 0, "Unknown", "unknown")]
    assert [r["speakers"] for r in chunking.speakers(chunking.marked_turns(df, "id"), "id").orderBy("id").collect()] == [["Ann Lee", "Bo Ray"], ["Unknown"]]


def test_articles(spark):
    page = "<div class='article-body'>" + "".join(f"<p>{p}</p>" for p in ("<strong>Ann Lee -- Chief Executive Officer:</strong> We did very well this year.", "And we go on.", "<b>Bo Ray -- Bay Capital:</b>", "What about the costs of it?", "<strong>Cy Doe:</strong> no", "<b>Ed Fox:</b> That is all we have today.")) + "</div>"
    df = spark.createDataFrame([(1, page), (2, "<p>one</p>"), (3, None)], "id int, html string")
    got = [tuple(r) for r in articles.turns(df, "id").orderBy("turn_index").collect()]
    assert got == [(1, 0, "Ann Lee", "CEO", "issuer", "We did very well this year. And we go on."), (1, 1, "Bo Ray", "Analyst", "Bay Capital", "What about the costs of it?"), (1, 2, "Ed Fox", "Executive", "Unknown", "That is all we have today.")]
    pages = spark.createDataFrame([("ABC", 0, "/x/abc-q2-2023", "ABC other"), ("ABC", 1, "https://h/abc", "ABC 2024 third quarter call"), ("ABC", 2, "/abc-q3-2024", "later")], "page_ticker string, n int, href string, text string")
    calls = spark.createDataFrame([("ABC", "Q3", 2024), ("ABC", "Q2", 2023), ("ABC", "Q1", 2020)], "ticker string, quarter string, year int")
    assert sorted(tuple(r) for r in articles.links(pages, calls, "https://b").collect()) == [("ABC", "Q2", 2023, "https://b/x/abc-q2-2023"), ("ABC", "Q3", 2024, "https://h/abc")]


def test_long_texts_keep_their_end(spark):
    t = spark.createDataFrame([(1, " ".join(f"Sentence {i} " + "word " * 400 + "ends." for i in range(700)))], "id int, text string")
    rows = chunking.windows(t, "id").orderBy("chunk_index").collect()
    assert len(rows) == rows[0]["total_chunks"] > 500 and "Sentence 699 " in rows[-1]["chunk"]
    some = chunking.windows(t, "id", most=3).collect()
    assert len(some) == 3 and some[0]["total_chunks"] == len(rows)


def test_evaluation(spark):
    rows = [(True, 0.5, 0, "industry", "company"), (False, 0.9, 1, "contradiction", "ragas_prep"), (True, 0.5, 3, "contradiction", "ragas_prep")]
    df = spark.createDataFrame(rows, "m boolean, g double, h int, a string, b string")
    a, b = evaluation.route(F.col("m"), F.col("g"), F.col("h"))
    assert df.where((a != F.col("a")) | (b != F.col("b"))).count() == 0
    assert one(spark, evaluation.intent_of(F.lit("What are the risks?"))) == "risk_assessment"
    moves = spark.createDataFrame([("A", "upgraded to buy"), ("A", "downgrade"), ("A", "hold")], "ticker string, change string")
    assert frame_rows(quality.revision_moves(moves)) == [("A", 1, 1, 0.0)]


def qa_chunks(spark):
    rows = [
        (1, "Record strong growth and margins improved.", "ABC", "mda", "Q1", 2024, 6), (2, "Margins fell on weak demand and a loss.", "ABC", "qa", "Q1", 2024, 8), (3, "Risk of litigation.", "ABC", "risk_factors", "Q2", 2024, 3),
        (4, "Peer margins were flat.", "DEF", "mda", "Q1", 2024, 4), (5, "Peer costs rose.", "GHI", "mda", "Q1", 2024, 3), (6, "Inflation slowed in the economy.", "__MACRO__", "unknown", "Q1", 2024, 5),
    ]
    return spark.createDataFrame(rows, "chunk_id long, text string, ticker string, section string, quarter string, year int, words int")


def test_question_graph(spark):
    requests = spark.createDataFrame([(1, "abc ", "How do margins compare with peers of the industry and the economy?"), (2, "ABC", "Risk of litigation?"), (3, "NONE", "What about margins?"), (4, None, "no company"), (5, "ABC", None), (None, "ABC", "x")], "request_id long, ticker string, question string")
    peers = qa.peer_table(spark, {"ABC": ["DEF", "GHI", "JKL", "MNO"]})
    assert peers.count() == 3 and qa.peer_table(spark).count() == 27
    got = {r["request_id"]: r for r in qa.answer_each(requests, qa_chunks(spark), peers=peers).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert got[1]["intent"] == "comparative_analysis" and got[1]["hops"] == 3 and "PEER 1: DEF" not in got[1]["macro_context"]
    assert got[2]["intent"] == "risk_assessment" and got[2]["hops"] == 1 and got[2]["answer"].endswith("Risk of litigation.")
    assert got[3]["context"] == "" and got[3]["grade"] == 0 and got[4]["error"] and got[5]["error"] and got[1]["error"] is None


def test_question_graph_with_a_model(spark):
    from pyspark.sql.types import StringType

    seen = F.udf(lambda p: "general." if p.startswith("Which of these") else "Written from the context." if p else None, StringType())
    asks = F.udf(lambda p: '{"score": 0.9}' if p.startswith("Context:") else '```json\n{"has_gaps": true, "needs_peer_data": true, "needs_macro_data": true}\n```', StringType())
    requests = spark.createDataFrame([(1, "ABC", "Anything?")], "request_id long, ticker string, question string")
    scores = spark.createDataFrame([("ABC", "Q1", 2024, 0.4, 0.1, 0.2, 0.3, 0.4)], "ticker string, quarter string, year int, composite_score double, drift double, guidance double, accruals double, analyst double")
    alerts = spark.createDataFrame([("ABC", "RED", "tone fell")], "ticker string, alert_level string, alert_reason string")
    r = qa.answer(requests, qa_chunks(spark), peers=qa.peer_table(spark, {"ABC": ["DEF", "GHI"]}), scores=scores, alerts=alerts, complete=seen, ask_json=asks).first()
    assert r["intent"] == "general" and r["hops"] == 1 and r["grade"] == 0.9 and r["answer"] == "Written from the context." and r["contradictions"] == 2
    assert "[PEER 1: DEF" in r["peer_context"] and "Peer costs rose." in r["peer_context"] and "Inflation slowed" in r["macro_context"] and len(r["contexts"]) == 3


def test_prompts(spark):
    none = F.lit(None).cast("array<struct<score: double, source_a: string, source_b: string, interpretation: string>>")
    assert one(spark, prompts.contradictions_text(none)) == "None detected."
    many = F.array(*[F.struct(F.lit(0.9).alias("score"), F.lit("a").alias("source_a"), F.lit("b").alias("source_b"), F.lit(f"i{i}").alias("interpretation")) for i in range(7)])
    said = one(spark, prompts.contradictions_text(many))
    assert "  5. conflict (score=0.90)\n     Source A: a" in said and "6." not in said
    text = one(spark, prompts.synthesis(F.lit("ABC"), F.lit("Q1 2024"), F.repeat(F.lit("x"), 7000), F.lit(0.45), {"drift": F.lit(-0.1)}, F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0), F.lit("")))
    assert "Composite score: +0.450 (LONG)" in text and "- drift: -0.100" in text and "Tone alert: GREEN" in text and "None detected." in text and "x" * 6000 in text and "x" * 6001 not in text
    assert "No context retrieved." in one(spark, prompts.gaps(F.lit("A"), F.lit("q"), F.lit(""))) and one(spark, prompts.extraction(F.repeat(F.lit("y"), 4000))).count("y") == 3001
    assert one(spark, prompts.quality_check(F.repeat(F.lit("z"), 5000), F.lit("a"))).count("z") == 4000 and "macro_context" in one(spark, prompts.classification(F.lit("q")))


def test_client_falls_back():
    calls, waits = [], []

    def failing(message):
        def run(system, prompt):
            calls.append(message)
            raise RuntimeError(message)

        return run

    good = lambda system, prompt: f"{system}:{prompt}"
    assert client.complete([failing("429 rate limit"), good], "s", "p", waits.append) == "s:p" and calls == ["429 rate limit"]
    calls.clear()
    assert client.complete([failing("connection timeout"), good], "s", "p", waits.append) == "s:p" and len(calls) == 3 and waits == [1.0, 2.0]
    calls.clear()
    assert client.complete([failing("bad key")], "s", "p", waits.append) is None and len(calls) == 1
    assert client.is_rate_limited("HTTP 429") and client.is_retryable("503 unavailable") and not client.is_retryable("bad key")


def test_client_column(spark):
    df = spark.createDataFrame([("a",), (None,)], "p string")
    assert [r[0] for r in df.select(client.completer(lambda: [lambda s, p: p.upper()])(F.col("p"))).collect()] == ["A", None]
    assert [r[0] for r in df.select(client.completer(lambda: 1 / 0)(F.col("p"))).collect()] == [None, None]


def test_evaluate(spark):
    rows = [("what margin", "margin rose", ["the margin rose"], "the margin rose"), ("q", "", [], None), (None, "a b", ["a"], None)]
    got = evaluation.evaluate(spark.createDataFrame(rows, "question string, answer string, contexts array<string>, ground_truth string")).collect()
    assert (got[0]["faithfulness"], got[0]["answer_relevance"], got[0]["context_precision"], got[0]["context_recall"]) == (1.0, 0.5, 0.45, 1.0)
    assert got[1]["faithfulness"] is None and got[1]["mean_score"] == 0 and got[2]["faithfulness"] == 0.5 and got[2]["context_recall"] is None


def test_numbered_needs_no_single_task(spark):
    df = spark.range(500).selectExpr("id % 3 as g", "(id * 7919) % 101 as x", "id")
    got = backtest.numbered(df, ["g"], ["x", "id"], "n")
    want = df.withColumn("n", F.expr("row_number() over (partition by g order by x, id)").cast("bigint"))
    assert sorted(map(tuple, got.select("g", "x", "id", "n").collect())) == sorted(map(tuple, want.select("g", "x", "id", "n").collect()))
    assert backtest.numbered(df.limit(0), ["g"], ["x"], "n").count() == 0


def test_all_characters_that_composing_changes_are_seen():
    import re
    import unicodedata

    ranges = [(int(a, 16), int(b, 16)) for a, b in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", T._UNCOMPOSED)]
    for i in (i for i in range(0x110000) if not 0xD800 <= i < 0xE000):
        c = chr(i)
        if unicodedata.normalize("NFC", c) != c or unicodedata.combining(c) or len(unicodedata.normalize("NFC", "e" + c)) != 2:
            assert unicodedata.category(c)[0] == "M" or any(a <= i <= b for a, b in ranges), hex(i)
