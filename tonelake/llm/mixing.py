"""Mixtures of sources at target weights (problem 7).

Documents are aggregated by membership pattern (the set of sources they belong to). For each mixture a min-cost flow
sends the tokens of the patterns to the quotas of the sources; a further repetition of a pattern costs more than the one
before, so nothing is repeated while unused tokens can fill a quota. A seeded order lays a pattern's documents on a circle as long
as their tokens, and the pattern's sources take consecutive arcs of it: no document is used once more before all others
of its pattern were. A histogram of the order tells the place of nearly all documents; only those around the ends of arcs are sorted.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.storage import small_enough, stage

#: membership patterns, and rows of mixture targets, that the driver plans with at most; more are an error
PATTERNS, TARGETS = 10_000, 100_000
#: steps of the histogram of the seeded order; a step's documents are sorted in one task, if an arc ends there
STEPS = 1 << 14
#: arcs and steps that are broadcast at most; more are joined by a shuffle
BROADCAST_ROWS = 200_000
#: repetitions of a pattern that have a price each; beyond them the price is the same up to twice as many
PRICED = 64
_ARCS = "mix_id int, pattern string, source string, whole bigint, start bigint, stop bigint"


def min_cost_flow(edges: list[tuple[str, str, int, int]], start: str, end: str) -> list[int]:
    """The flow on each edge (from, to, capacity, cost) of a largest flow of least cost, by cheapest augmenting paths with potentials."""
    graph: dict[str, list[int]] = defaultdict(list)
    to, left, cost = [], [], []
    for a, b, capacity, price in edges:
        graph[a].append(len(to))
        to.append(b), left.append(capacity), cost.append(price)
        graph[b].append(len(to))
        to.append(a), left.append(0), cost.append(-price)
    height: dict[str, int] = defaultdict(int)
    while True:
        far, via, heap = {start: 0}, {}, [(0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in graph[a]:
                if left[e] > 0 and (n := d + cost[e] + height[a] - height[to[e]]) < far.get(to[e], n + 1):
                    far[to[e]], via[to[e]] = n, e
                    heapq.heappush(heap, (n, to[e]))
        if end not in far:
            return [capacity - left[2 * i] for i, (_, _, capacity, _) in enumerate(edges)]
        furthest = max(far.values())
        for a in graph:
            height[a] += far.get(a, furthest)
        path, a = [], end
        while a != start:
            path.append(via[a])
            a = to[via[a] ^ 1]
        most = min(left[e] for e in path)
        for e in path:
            left[e] -= most
            left[e ^ 1] += most


def laps_by_price(most: int) -> list[tuple[int, int]]:
    """Segments (price, repetitions) of the convex cost of so many repetitions: PRICED single ones, then ones of doubling length."""
    out = [(k, 1) for k in range(1, min(most, PRICED) + 1)]
    at = PRICED
    while at < most:
        out.append((at + 1, min(at, most - at)))
        at *= 2
    return out


def arcs(size: int, given: list[tuple[str, int]], turn: int) -> list[tuple[str, int, int, int]]:
    """source, whole laps, start and stop of its arc on a circle of so many tokens, one source after the other from a first place on."""
    out, at = [], turn % size
    for source, n in given:
        whole, rest = divmod(n, size)
        out.append((source, whole, at, (at + rest) % size if rest else at))
        at = (at + rest) % size
    return out


def plan(tokens: dict[tuple[str, ...], int], total: int, targets: list[tuple[str, float, int]], ratio: float) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens that each (pattern, source) gives to one mixture. targets: source, weight, most repeats. total: tokens of all documents."""
    targets = [(s, w, r) for s, w, r in targets if w > 0]
    weights = sum(w for _, w, _ in targets)
    quotas = {s: round(total * ratio * w / weights) for s, w, _ in targets}
    repeats = {s: max(0, r) for s, _, r in targets}
    edges: list[tuple[str, str, int, int]] = []
    gives: dict[tuple[tuple[str, ...], str], int] = {}
    for pattern, size in sorted(tokens.items()):
        own = [s for s in pattern if s in quotas]
        for first, laps in laps_by_price(sum(repeats[s] for s in own)):
            edges.append(("start", f"p{pattern}", size * laps, first))
        for s in own:
            gives[pattern, s] = len(edges)
            edges.append((f"p{pattern}", f"s{s}", size * repeats[s], 0))
    edges += [(f"s{s}", "end", q, 0) for s, q in quotas.items()]
    flow = min_cost_flow(edges, "start", "end")
    return {k: flow[i] for k, i in gives.items() if flow[i]}


def _documents(sized: DataFrame, sources: str, tokens: str, key: str) -> DataFrame:
    s = F.col(sources)
    as_array = s if dict(sized.dtypes)[sources].startswith("array") else F.array(s)
    clean = F.array_sort(F.array_distinct(F.filter(as_array, lambda x: x.isNotNull())))
    return sized.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), clean.alias("sources"), F.to_json(clean).alias("pattern"), F.coalesce(F.col(tokens).cast("bigint"), F.lit(0)).alias("n"))


def _targets(mixes: DataFrame) -> dict[int, list]:
    rows = mixes.where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(F.max("weight").alias("w"), F.max("max_repeats").alias("r"), F.max("total_ratio").alias("t")).limit(TARGETS + 1).collect()
    if len(rows) > TARGETS:
        raise ValueError(f"more than {TARGETS} mixture targets")
    found: dict[int, list] = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["mix_id"], r["source"])):
        found[r["mix_id"]].append((r["source"], r["w"] if r["w"] and r["w"] > 0 else 0.0, 1 if r["r"] is None else r["r"], r["t"]))
    return found


def mixture(sized: DataFrame, mixes: DataFrame, key: str = "doc_id", sources: str = "source", tokens: str = "n_tokens", seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The documents of each mixture, and the shares that it reaches.

    documents: mix_id, key, source, n_tokens, repeats (at least 1): one row for each mixture, document and source it serves.
    shares: mix_id, source, target_share, actual_share, target_tokens, actual_tokens, documents: one row for each target.
    sources is a name or an array of names. Shares are of the tokens of the mixture. A source that can't fill its quota with
    max_repeats repetitions falls short, and the others keep theirs, which keeps all shares nearest to the targets for the given size; weights
    that are null or not positive are 0, a null max_repeats is 1, a null total_ratio 1; of targets of the same mix and source the largest
    values hold. Documents without source, tokens or key are in no mixture, but their tokens count in the size of
    all. The choice depends on the seed and keys alone. Empty tables give no documents. Other columns are ignored.
    """
    spark = sized.sparkSession
    order = F.xxhash64(F.lit(seed), "k")
    documents = _documents(sized, sources, tokens, key).withColumn("h", order).withColumn("step", F.shiftrightunsigned("h", 64 - STEPS.bit_length() + 1).cast("int"))
    documents = stage(documents, "sized")
    capacity = documents.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("n").alias("n")).limit(PATTERNS + 1).collect()
    if len(capacity) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} membership patterns")
    size = {tuple(r["sources"]): r["n"] for r in capacity}
    name = {tuple(r["sources"]): r["pattern"] for r in capacity}
    total = sum(size.values())
    planned, wanted = [], []
    for mix_id, rows in _targets(mixes).items():
        ratio = max((t for *_, t in rows if t is not None), default=1.0)
        weights = sum(w for _, w, _, _ in rows) or 1.0
        wanted += [(mix_id, s, w / weights, round(total * ratio * w / weights)) for s, w, _, _ in rows]
        given: dict[tuple[str, ...], list[tuple[str, int]]] = defaultdict(list)
        for (p, s), n in plan({p: n for p, n in size.items() if n}, total, [r[:3] for r in rows], ratio).items():
            given[p].append((s, n))
        for p, parts in given.items():
            turn = xxhash.xxh3_64_intdigest(f"{seed} {mix_id} {name[p]}".encode())
            planned += [(mix_id, name[p], *arc) for arc in arcs(size[p], parts, turn)]
    plans = spark.createDataFrame(planned, _ARCS)
    # The step of the histogram that each end of an arc falls into: both sorted along the circle.
    sums = documents.where("n > 0").groupBy("pattern", "step").agg(F.sum("n").alias("n"))
    sums = sums.select("pattern", F.expr("sum(n) over (partition by pattern order by step) - n").alias("at"), "step")
    ends = plans.where("start <> stop").select("pattern", F.explode(F.array("start", "stop")).alias("at")).distinct().withColumn("step", F.lit(None).cast("int"))
    ends = sums.withColumn("end", F.lit(0)).unionByName(ends.withColumn("end", F.lit(1)))
    ends = ends.select("pattern", "at", "end", F.expr("last(step, true) over (partition by pattern order by at, end rows unbounded preceding)").alias("step"))
    ends = stage(ends.where("end = 1").select("pattern", "at", "step"), "ends")
    few = small_enough(ends, BROADCAST_ROWS)
    near = lambda df: F.broadcast(df) if few else df
    start, stop = (ends.select("pattern", F.col("at").alias(x), F.col("step").alias(f"{x}_step")) for x in ("start", "stop"))
    arcs_ = stage(plans.join(near(start), ["pattern", "start"], "left").join(near(stop), ["pattern", "stop"], "left"), "arcs")
    # Documents of those steps are placed exactly (by their middle), all others by their step.
    edge = near(ends.select("pattern", "step").distinct())
    before = sums.select("pattern", "step", F.col("at").alias("before")).join(edge, ["pattern", "step"])
    exact = documents.where("n > 0").join(near(before), ["pattern", "step"])
    exact = exact.withColumn("middle", F.expr("2 * (before + sum(n) over (partition by pattern, step order by h, k rows unbounded preceding)) - n"))
    apart = documents.where("n > 0").join(edge, ["pattern", "step"], "left_anti").withColumn("middle", F.lit(None).cast("bigint"))
    columns = ["k", "pattern", "n", "step", "middle"]
    placed = exact.select(*columns).unionByName(apart.select(*columns)).join(F.broadcast(arcs_) if small_enough(arcs_, BROADCAST_ROWS) else arcs_, "pattern")
    after = F.when(F.col("middle").isNull(), F.col("step") > F.col("start_step")).otherwise(F.col("middle") >= 2 * F.col("start"))
    short = F.when(F.col("middle").isNull(), F.col("step") < F.col("stop_step")).otherwise(F.col("middle") < 2 * F.col("stop"))
    taken = F.when(F.col("start") == F.col("stop"), False).when(F.col("start") < F.col("stop"), after & short).otherwise(after | short)
    chosen = placed.select("mix_id", F.col("k").alias(key), "source", F.col("n").alias("n_tokens"), (F.col("whole") + taken.cast("int")).cast("int").alias("repeats")).where("repeats > 0")
    target = spark.createDataFrame(wanted, "mix_id int, source string, target_share double, target_tokens bigint")
    got = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("a"), F.count("*").alias("d"))
    shares = target.join(F.broadcast(got), ["mix_id", "source"], "left").select(
        "mix_id", "source", "target_share", F.coalesce(F.col("a") / F.expr("sum(a) over (partition by mix_id)"), F.lit(0.0)).alias("actual_share"),
        "target_tokens", F.coalesce("a", F.lit(0)).alias("actual_tokens"), F.coalesce("d", F.lit(0)).alias("documents"),
    )
    return chosen, shares
