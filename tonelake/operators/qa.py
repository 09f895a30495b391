"""Questions answered from retrieved chunks: a batch of requests goes through the steps together, at most three times.

Steps: classify, retrieve from the company, look for gaps, retrieve from peers and from macro texts, check the retrieved for contradictions,
write the answer, grade it, and either go round again or prepare the evaluation. Each step is a function over columns with a deterministic
default; a language model (operators.client) takes its place where one is given.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.functions import prompts
from tonelake.functions import text as T
from tonelake.functions.labels import contradiction_sentence, source_label
from tonelake.operators import evaluation, models, vectors
from tonelake.storage import stage

#: chunks that a request retrieves of its company, of each of its peers, of macro texts, and contexts that go into the evaluation
K, PEER_K, MACRO_K, CONTEXTS = 10, 3, 5, 10
# The company under which macro texts are stored; peers of companies.
MACRO = "__MACRO__"
PEERS = {
    "AAPL": ["MSFT", "GOOGL", "AMZN"], "MSFT": ["AAPL", "GOOGL", "AMZN"], "GOOGL": ["MSFT", "META", "AMZN"], "AMZN": ["MSFT", "GOOGL", "AAPL"], "META": ["GOOGL", "SNAP", "TWTR"],
    "NVDA": ["AMD", "INTC", "QCOM"], "TSLA": ["F", "GM", "RIVN"], "JPM": ["BAC", "WFC", "GS"], "JNJ": ["PFE", "MRK", "ABBV"],
}
_GAPS = "has_gaps boolean, needs_peer_data boolean, needs_macro_data boolean"


def peer_table(spark, peers: dict[str, list[str]] | None = None) -> DataFrame:
    """ticker, peer, n: at most three peers of each company."""
    return spark.createDataFrame([(t, p, i) for t, ps in (PEERS if peers is None else peers).items() for i, p in enumerate(ps[:3])], "ticker string, peer string, n int")


def same_sector(companies: DataFrame) -> DataFrame:
    """ticker, peer, n: where no peers are named, the next three companies of the sector in the order of their names (around the end)."""
    c = companies.where("sector is not null").select("ticker", "sector").distinct()
    ranked = c.withColumn("i", F.expr("row_number() over (partition by sector order by ticker) - 1")).withColumn("of", F.expr("count(*) over (partition by sector)"))
    steps = ranked.select("ticker", "sector", "i", "of", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n")).where("n < of")
    return steps.withColumn("j", F.expr("(i + n) % of")).join(ranked.select("sector", F.col("i").alias("j"), F.col("ticker").alias("peer")), ["sector", "j"]).select("ticker", "peer", F.col("n").cast("int").alias("n"))


def _nearest(asked: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """request_id, rank, chunk columns: the k chunks nearest to each asked row (request_id, g, embedding) of the same g. chunks have g and embedding."""
    # a request may look into several groups: its id is told apart from chunks' by its sign
    q = asked.withColumn("id", -F.col("request_id") - 1).select("id", "embedding", "g")
    near = vectors.top_k(chunks.select(F.col("chunk_id").alias("id"), "embedding", "g").distinct(), q, "id", "embedding", k, "g")
    return near.select((-F.col("query_id") - 1).alias("request_id"), F.col("neighbour_id").alias("chunk_id"), "rank", "score")


def _retrieve(requests: DataFrame, embedded: DataFrame, k: int, by_intent: bool) -> DataFrame:
    """request_id, rank, chunk columns: the k nearest chunks of the request's company (and, if asked, of its intent's sections)."""
    q, c = requests, embedded
    if by_intent:
        sections = F.try_element_at(F.create_map(*[x for i, s in evaluation.INTENTS.items() for x in (F.lit(i), F.array(*[F.lit(v) for v in s]))]), F.col("intent"))
        q = q.withColumn("part", F.explode(F.coalesce(sections, F.array(F.lit("*")))))
        c = c.withColumn("part", F.explode(F.array("section", F.lit("*"))))
        q, c = q.withColumn("g", F.concat_ws("|", "ticker", "part")), c.withColumn("g", F.concat_ws("|", "ticker", "part"))
    else:
        q, c = q.withColumn("g", F.col("ticker")), c.withColumn("g", F.col("ticker"))
    near = _nearest(q, c, k)
    near = near.withColumn("rank", F.expr("row_number() over (partition by request_id order by score desc, chunk_id)")).where(F.col("rank") <= k)
    return near.join(embedded.drop("embedding"), "chunk_id")


def gaps_by_words(question: Column, context: Column) -> Column:
    """The default gap finder: something is missing if the context holds too few of the question's words; peers and macro texts are needed if the question speaks of them."""
    q = F.lower(question)
    return F.struct(
        (evaluation.overlap(question, context) < evaluation.GRADE).alias("has_gaps"), q.rlike(r"\b(?:peers?|industry|competitors?|compared?|sector|rivals?)\b").alias("needs_peer_data"),
        q.rlike(r"\b(?:macro|economy|economic|inflation|interest rates?|gdp)\b").alias("needs_macro_data"),
    )


def find_gaps(requests: DataFrame, complete=None) -> DataFrame:
    """requests with has_gaps, needs_peer_data, needs_macro_data. A model's reply that is no JSON tells of no gaps; after the last hop there are none."""
    found = gaps_by_words(F.col("question"), F.col("company_context")) if complete is None else T.json_reply(complete(prompts.gaps(F.col("ticker"), F.col("question"), F.col("company_context"))), _GAPS)
    more = F.col("hops") < evaluation.MOST_HOPS
    part = lambda c: (F.coalesce(F.col("found")[c], F.lit(False)) & more).alias(c)
    return requests.withColumn("found", found).select("*", part("has_gaps"), part("needs_peer_data"), part("needs_macro_data")).drop("found")


def _contradictions(got: DataFrame, score=models.opposed) -> DataFrame:
    """request_id, contradictions: what contradicts each other among a request's retrieved chunks, by score; a request has at most k of them, so its pairs are few."""
    x = got.select("request_id", "chunk_id", "quarter", "year", source_label(F.col("ticker"), F.lit("chunk"), F.col("quarter"), F.col("year"), F.col("section")).alias("source"), models.pair_tone(F.col("text")).alias("seen"))
    a, b = (x.select("request_id", *[F.col(c).alias(f"{c}_{side}") for c in ("chunk_id", "quarter", "year", "source", "seen")]) for side in "ab")
    pairs = a.join(b, "request_id").where("chunk_id_a < chunk_id_b").withColumn("score", score(F.col("seen_a"), F.col("seen_b"))["contradiction"]).where("score >= 0.70")
    same = (F.col("quarter_a") == F.col("quarter_b")) & (F.col("year_a") == F.col("year_b"))
    told = F.struct((-F.col("score")).alias("order"), "chunk_id_a", "chunk_id_b", "score", F.col("source_a"), F.col("source_b"), contradiction_sentence(F.col("score"), same, F.col("source_a"), F.col("source_b")).alias("interpretation"))
    return pairs.groupBy("request_id").agg(F.array_sort(F.collect_list(told)).alias("contradictions"))


def _context(got: DataFrame, name: str, k: int, prefix: str) -> DataFrame:
    return evaluation.context(got, "request_id", k, prefix=prefix).withColumnRenamed("context", name)


def extractive(context: Column) -> Column:
    """The default answer: the first block of the context."""
    return F.substring_index(context, "\n\n", 1)


def answer(requests: DataFrame, chunks: DataFrame, k: int = K, peers: DataFrame | None = None, scores: DataFrame | None = None, alerts: DataFrame | None = None, complete=None, ask_json=None) -> DataFrame:
    """request_id, intent, hops, grade, context, peer_context, macro_context, contradictions, answer, contexts of every request (request_id, ticker, question).

    The first hop looks into the sections of the intent, the second into all of the company, the third at twice as many chunks. Requests whose grade is enough leave the loop. A request
    that finds nothing comes out with an empty context and grade 0. request_id must be a whole number from 0. peers: ticker, peer, n. scores (ticker, quarter, year, composite_score and components)
    and alerts (ticker, alert_level, alert_reason) go into the prompt of a model: the latest of the company. complete and ask_json are column functions from prompt to reply.
    """
    spark = requests.sparkSession
    peers = peer_table(spark) if peers is None else peers
    intent = evaluation.intent_of(F.col("question"))
    if complete is not None:
        said = F.rtrim(F.lower(F.trim(complete(prompts.classification(F.col("question"))))), F.lit("."))
        intent = F.coalesce(F.when(said.isin(*prompts.INTENT_NAMES), said), F.lit("general"))
    known = requests.where("request_id is not null").dropDuplicates(["request_id"]).select("request_id", F.upper(F.trim("ticker")).alias("ticker"), "question").withColumn("intent", intent)
    known = models.embed(known, "question")
    if scores is not None:
        known = known.join(scores.groupBy("ticker").agg(F.max_by(F.struct(*[c for c in scores.columns if c != "ticker"]), F.expr("year * 10 + cast(substring(quarter, 2, 1) as int)")).alias("latest")), "ticker", "left")
    if alerts is not None:
        known = known.join(alerts.select("ticker", "alert_level", "alert_reason"), "ticker", "left")
    open_ = stage(known, "requests")
    embedded = stage(models.embed(chunks), "embedded")
    done = []
    for hop in range(1, evaluation.MOST_HOPS + 1):
        got = stage(_retrieve(open_, embedded, k * (1 + (hop == 3)), hop == 1), "retrieved")
        state = open_.join(_context(got, "company_context", k * 2, "SOURCE"), "request_id", "left").withColumn("company_context", F.coalesce("company_context", F.lit(""))).withColumn("hops", F.lit(hop))
        state = stage(find_gaps(state, ask_json), "gaps")
        more = state.where("has_gaps")
        by_peer = more.where("needs_peer_data").select("request_id", "ticker", "embedding").join(peers, "ticker").select("request_id", F.col("peer").alias("g"), "embedding")
        near = _nearest(by_peer, embedded.withColumn("g", F.col("ticker")), PEER_K * 3).join(embedded.drop("embedding"), "chunk_id").where("ticker is not null")
        near = near.withColumn("of", F.expr("row_number() over (partition by request_id, ticker order by score desc, chunk_id)")).where(F.col("of") <= PEER_K).withColumn("rank", F.expr("row_number() over (partition by request_id order by ticker, of)"))
        macro = more.where("needs_macro_data").select("request_id", F.lit(MACRO).alias("g"), "embedding")
        macro = _nearest(macro, embedded.withColumn("g", F.col("ticker")), MACRO_K).join(embedded.drop("embedding"), "chunk_id")
        state = state.join(_context(near, "peer_context", PEER_K * 3, "PEER"), "request_id", "left").join(_context(macro, "macro_context", MACRO_K, "MACRO"), "request_id", "left").join(_contradictions(got), "request_id", "left")
        headed = lambda c, title: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(title, F.lit("\n"), F.col(c)))
        whole = F.concat_ws("\n\n", headed("company_context", F.concat(F.lit("=== COMPANY CONTEXT ("), "ticker", F.lit(") ==="))), headed("peer_context", F.lit("=== PEER INDUSTRY CONTEXT ===")), headed("macro_context", F.lit("=== MACRO CONTEXT ===")))
        state = state.withColumn("whole", F.when(whole == "", "No context available.").otherwise(whole))
        if complete is None:
            state = state.withColumn("answer", extractive(F.col("company_context"))).withColumn("grade", evaluation.overlap(F.col("question"), F.col("company_context")))
        else:
            pick = lambda c: F.col("latest")[c] if scores is not None and c in scores.columns else F.lit(0.0)
            period = F.concat_ws(" ", pick("quarter").cast("string"), pick("year").cast("string")) if scores is not None else F.lit("the latest quarter")
            level, reason = (F.col("alert_level"), F.col("alert_reason")) if alerts is not None else (F.lit("GREEN"), F.lit(""))
            prompt = prompts.synthesis(F.col("ticker"), period, F.col("whole"), pick("composite_score"), {c: pick(c) for c in ("drift", "guidance", "accruals", "analyst")}, level, reason, F.greatest(F.lit(0), F.coalesce(F.size("contradictions"), F.lit(0))), prompts.contradictions_text(F.col("contradictions")))
            state = stage(state.withColumn("answer", F.coalesce(complete(prompt), F.lit("Analysis generation failed"))), "answers")
            check = (ask_json or complete)(prompts.quality_check(F.left("whole", F.lit(prompts.USED_CHARS)), F.col("answer")))
            state = state.withColumn("grade", F.coalesce(T.json_reply(check, "score double")["score"], F.lit(0.5)))
        graded = stage(state, "graded")
        _, after = evaluation.route(F.lit(False), F.col("grade"), F.col("hops"))
        done.append(graded if hop == evaluation.MOST_HOPS else graded.where(after != "company"))
        if hop < evaluation.MOST_HOPS:
            open_ = graded.where(after == "company").select(*open_.columns)
    all_ = reduce(DataFrame.unionByName, done)
    contexts = F.slice(F.filter(F.split("company_context", r"\n\n(?=\[SOURCE )"), lambda x: x != ""), 1, CONTEXTS)
    return all_.select("request_id", "ticker", "question", "intent", "hops", "grade", F.col("company_context").alias("context"), F.coalesce("peer_context", F.lit("")).alias("peer_context"), F.coalesce("macro_context", F.lit("")).alias("macro_context"), F.greatest(F.lit(0), F.coalesce(F.size("contradictions"), F.lit(0))).alias("contradictions"), "answer", contexts.alias("contexts"))


def answer_each(requests: DataFrame, chunks: DataFrame, **more) -> DataFrame:
    """answer(), and a row with an error for every request that can't be answered: one without a company or a question."""
    usable = F.coalesce(F.trim("ticker") != "", F.lit(False)) & F.coalesce(F.trim("question") != "", F.lit(False))
    failed = requests.where("request_id is not null").where(~usable).dropDuplicates(["request_id"]).select("request_id", "ticker", "question", F.lit("a request needs a company and a question").alias("error"))
    return answer(requests.where(usable), chunks, **more).withColumn("error", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True)
