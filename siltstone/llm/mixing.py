"""Mixing overlapping sources to target weights by min-cost flow.

Documents are summed up by membership pattern (the set of sources that a
document belongs to). Words flow from patterns to the quotas of their sources;
the first use of a pattern's words is cheap and each repetition dearer, so the
optimal flow repeats as little as the quotas allow. The flow through a pattern
then picks its documents in a seeded order: whole rounds take all of them, the
rest takes those up to a cut, goes on with smaller ones where the next is too
long, and takes one more that fits the remainder best.

What comes to the driver is a row for each pattern and source, never for a
document. Up to a checked number of patterns selection needs no shuffle of texts:
a pattern's cuts and its filler are broadcast, and documents are held against them
where they are; beyond it they are joined by shuffle.

Cases: a null text has size 0 and is never taken; null is a source of its own,
after all others; documents without any source are not taken; equal rows share
their place in the order and are taken together; an empty table gives no rows;
columns of the input that clash with a result column are replaced (the results'
names take a prefix); names that begin with two underscores are ours.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.shared import store

WORD = r"[^\x20\x09-\x0D]+"
ROWS_IN_BUCKET, MOST_BUCKETS = 20_000, 65_536
BROADCAST_PATTERNS = 100_000  # rows of a pattern's plan


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quotas(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float], share: float, most: float) -> dict[str | None, float]:
    """Targets of sources: ``share`` of all words by cyclic weights in code point
    order, none above ``most`` times its source's size; the excess is dealt out
    again by weight among the others until none is above."""
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode("utf-8", "surrogatepass")))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    cap = {s: most * n for s, n in order}
    out: dict[str | None, float] = {}
    left, open_ = share * sum(n for _, n in order), [s for s, _ in order]
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > cap[s]]
        if not above:
            return out | {s: left * weight[s] / total for s in open_}
        for s in above:
            out[s] = cap[s]
        left -= sum(cap[s] for s in above)
        open_ = [s for s in open_ if s not in out]
    return out


def _groups(patterns: Sequence[tuple]) -> list[list[tuple]]:
    """Patterns that share sources, directly or by others."""
    parent: dict = {}

    def top(s):
        while parent.setdefault(s, s) != s:
            parent[s] = parent[parent[s]]
            s = parent[s]
        return s

    for p in patterns:
        for s in p[1:]:
            parent[top(s)] = top(p[0])
    out: dict = {}
    for p in patterns:
        out.setdefault(top(p[0]), []).append(p)
    return list(out.values())


def route(capacity: Mapping[tuple, int], targets: Mapping[str | None, float], rounds: int) -> dict[tuple, dict[str | None, float]]:
    """Words that each pattern gives to each of its sources: a cheapest flow
    among the largest ones, where use r of a pattern's words costs 2r - 1. Groups
    of sources that no document joins are solved apart."""
    out: dict[tuple, dict[str | None, float]] = {}
    for group in _groups(list(capacity)):
        named = {s for p in group for s in p}
        out |= _flow({p: capacity[p] for p in group}, {s: targets[s] for s in named if s in targets}, rounds)
    return out


def _flow(capacity: Mapping[tuple, int], targets: Mapping[str | None, float], rounds: int) -> dict[tuple, dict[str | None, float]]:
    patterns, sources = list(capacity), list(targets)
    node = {("p", p): 1 + i for i, p in enumerate(patterns)} | {("s", s): 1 + len(patterns) + i for i, s in enumerate(sources)}
    sink = 1 + len(node)
    head: list[list[int]] = [[] for _ in range(sink + 1)]
    to: list[int] = []
    room: list[float] = []
    cost: list[int] = []

    def edge(a: int, b: int, most: float, price: int) -> int:
        for x, y, m, c in ((a, b, most, price), (b, a, 0.0, -price)):
            head[x].append(len(to))
            to.append(y)
            room.append(m)
            cost.append(c)
        return len(to) - 2

    gives = {}
    for p in patterns:
        for r in range(1, rounds + 1):
            edge(0, node["p", p], float(capacity[p]), 2 * r - 1)
        for s in p:
            if ("s", s) in node:
                gives[p, s] = edge(node["p", p], node["s", s], float("inf"), 0)
    for s in sources:
        edge(node["s", s], sink, float(targets[s]), 0)
    potential = [0] * (sink + 1)
    while True:
        far, by = [None] * (sink + 1), [-1] * (sink + 1)
        far[0], queue = 0, [(0, 0)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for e in head[a]:
                if room[e] > 1e-9:
                    n = d + cost[e] + potential[a] - potential[to[e]]
                    if far[to[e]] is None or n < far[to[e]]:
                        far[to[e]], by[to[e]] = n, e
                        heapq.heappush(queue, (n, to[e]))
        if far[sink] is None:
            return {p: {s: room[gives[p, s] ^ 1] for s in p if (p, s) in gives} for p in patterns}
        potential = [x + (far[sink] if d is None else min(d, far[sink])) for x, d in zip(potential, far, strict=True)]
        path, a = [], sink
        while a:
            path.append(by[a])
            a = to[by[a] ^ 1]
        flow = min(room[e] for e in path)
        for e in path:
            room[e] -= flow
            room[e ^ 1] += flow


def _order_key(seed: str, id_col: str, text_col: str) -> Column:
    """A document's place in the seeded order, in 62 bits."""
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).bitwiseAND(F.lit((1 << 62) - 1))


def _prefix(rows: DataFrame, rest: DataFrame, buckets: int, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(pattern, cut, short): the last key below which all rows of a pattern fit into
    its words, and the words that are left."""
    width = -(-(1 << 62) // buckets)
    partial = rows.join(small(rest), "pattern").withColumn("bucket", F.floor(F.col("key") / F.lit(width)).cast("long"))
    sums = partial.groupBy("pattern", "bucket").agg(F.sum("size").alias("size"), F.first("words").alias("words"))
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    sums = sums.withColumn("upto", F.col("before") + F.col("size"))
    edge = sums.filter((F.col("before") <= F.col("words")) & (F.col("upto") > F.col("words"))).select("pattern", "bucket", "before")
    keys = partial.join(small(edge), ["pattern", "bucket"]).groupBy("pattern", "key").agg(F.sum("size").alias("size"), F.first("words").alias("words"), F.first("before").alias("before"), F.first("bucket").alias("bucket"))
    running = Window.partitionBy("pattern").orderBy("key")
    keys = keys.withColumn("upto", F.col("before") + F.sum("size").over(running))
    last = keys.groupBy("pattern").agg(
        F.max(F.when(F.col("upto") <= F.col("words"), F.struct("key", "upto"))).alias("last"), F.first("bucket").alias("bucket"), F.first("before").alias("before"), F.first("words").alias("words")
    ).select("pattern", F.coalesce("last.key", F.col("bucket") * F.lit(width) - 1).alias("cut"), (F.col("words") - F.coalesce("last.upto", "before")).alias("short"))
    whole = sums.groupBy("pattern").agg(F.max("upto").alias("upto"), F.first("words").alias("words")).filter("upto <= words")
    return last.unionByName(whole.select("pattern", F.lit((1 << 62) - 1).alias("cut"), (F.col("words") - F.col("upto")).alias("short")))


def cuts(rows: DataFrame, rest: DataFrame, n_rows: int, small: Callable[[DataFrame], DataFrame] = F.broadcast, near: float = 0.001) -> DataFrame:
    """For each pattern with words to take in part: steps of (limit, cut), where rows
    of at most ``limit`` words are taken up to the key ``cut``, and the key of one
    more document that fits the remainder best.

    The first step takes rows of every size; each further one goes on with those of
    at most half of what is still short, so what is short halves, or all of these
    rows are taken. It ends when no pattern is short of more than ``near`` of its words,
    or its next rows are repeated ones that fit only apart: they are taken together.

    rows: pattern, key, size; rest: pattern, words (one row for each pattern);
    small: a hint for tables of at most a row for each pattern.
    """
    buckets = min(MOST_BUCKETS, max(64, n_rows // ROWS_IN_BUCKET))
    any_size = F.lit((1 << 62) - 1).alias("limit")
    state = rest.select("pattern", (F.col("words") * near).alias("enough"), "words").join(_prefix(rows, rest, buckets, small), "pattern")
    state = store(state.select("pattern", "enough", F.col("short").cast("double").alias("short"), F.array(F.struct(any_size, "cut")).alias("steps"), F.lit(True).alias("open")), "mix-steps")
    while True:
        half = F.floor(F.col("short") / 2).cast("long")
        open_ = state.filter(F.col("open") & (F.col("short") > F.col("enough"))).select("pattern", F.col("short").alias("words"), half.alias("limit"), F.element_at("steps", -1)["cut"].alias("from"))
        fit = rows.join(small(open_.select("pattern", "limit", "from")), "pattern").filter((F.col("key") > F.col("from")) & (F.col("size") > 0) & (F.col("size") <= F.col("limit"))).select("pattern", "key", "size")
        step = store(_prefix(fit, open_.select("pattern", "words"), buckets, small).join(small(open_.select("pattern", "limit", "from")), "pattern").select("pattern", F.col("short").alias("left"), "limit", F.greatest("cut", "from").alias("cut")), "mix-step")
        if step.isEmpty():
            break
        more = F.when(F.col("cut").isNotNull(), F.concat("steps", F.array(F.struct("limit", "cut")))).otherwise(F.col("steps"))
        state = store(state.join(small(step), "pattern", "left").select("pattern", "enough", F.coalesce("left", "short").alias("short"), more.alias("steps"), F.coalesce(F.col("left") < F.col("short"), F.lit(False)).alias("open")), "mix-steps")
    left = rows.join(small(state.select("pattern", "short", "steps")), "pattern").filter(~_taken(F.col("steps"), F.col("key"), F.col("size")) & (F.abs(F.col("size") - F.col("short")) < F.col("short")))
    filler = left.groupBy("pattern").agg(F.min(F.struct(F.abs(F.col("size") - F.col("short")).alias("off"), "key")).alias("best")).select("pattern", F.col("best.key").alias("filler"))
    return state.join(small(filler), "pattern", "left").select("pattern", "steps", "filler")


def _taken(steps: Column, key: Column, size: Column) -> Column:
    return F.exists(steps, lambda s: (size <= s["limit"]) & (key <= s["cut"]))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "siltstone", id_col: str = "doc_id", text_col: str = "text", sources: Column | None = None, prefix: str = "") -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken, after ``prefix``.

    sources: an array of the sources of a document; its source column if None.
    source_size and target are those of the document's first source.
    """
    spark = docs.sparkSession
    member = F.array(F.col("source")) if sources is None else F.array_sort(F.array_distinct(sources))
    size, source_size, target_, copies_, taken = (prefix + x for x in ("size", "source_size", "target", "copies", "taken"))
    base = docs.withColumns({"__mix_pattern": member, "__mix_key": _order_key(seed, id_col, text_col), "__mix_size": word_count(F.col(text_col))}).drop(size, source_size, target_, copies_, taken)
    rows = store(base.select(F.col("__mix_pattern").alias("pattern"), F.col("__mix_key").alias("key"), F.col("__mix_size").alias("size")).filter("pattern is not null and size(pattern) > 0"), "mix-rows")
    patterns = rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    capacity = {tuple(r["pattern"]): r["size"] for r in patterns}
    sizes: dict[str | None, int] = {}
    for p, n in capacity.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    target = quotas(list(sizes.items()), weights, share, most)
    flow = route(capacity, target, max(1, int(-(-most // 1))))
    kind = rows.schema["pattern"].dataType.simpleString()
    schema = f"__mix_p {kind}, __mix_source_size long, __mix_target double, __mix_whole int, words double"
    plan = []
    for p, n in capacity.items():
        words = sum(flow[p].values())
        whole = int(words // n) if n else 0
        plan.append((list(p), sizes[p[0]], target[p[0]], whole, words - whole * n))
    small = F.broadcast if len(plan) <= BROADCAST_PATTERNS else lambda df: df
    plans = spark.createDataFrame(plan, schema)
    partial = [(p, w) for p, _, _, _, w in plan if w > 0.5]
    cut = cuts(rows, spark.createDataFrame(partial, f"pattern {kind}, words double"), sum(r["n"] for r in patterns), small)
    if partial:
        cut = store(cut, "mix-cuts")
    plans = plans.join(small(cut), plans["__mix_p"].eqNullSafe(cut["pattern"]), "left").select("__mix_p", "__mix_source_size", "__mix_target", "__mix_whole", F.col("steps").alias("__mix_steps"), F.col("filler").alias("__mix_filler"))
    held = base.join(small(plans), F.col("__mix_pattern") == F.col("__mix_p"), "left")
    more = F.coalesce((_taken(F.col("__mix_steps"), F.col("__mix_key"), F.col("__mix_size")) | (F.coalesce(F.col("__mix_key") == F.col("__mix_filler"), F.lit(False)))).cast("int"), F.lit(0))
    copies = F.when(F.col("__mix_size") == 0, 0).otherwise(F.coalesce(F.col("__mix_whole"), F.lit(0)) + more).cast("int")
    return held.select(*base.drop("__mix_pattern", "__mix_key", "__mix_size").columns, F.col("__mix_size").alias(size), F.col("__mix_source_size").alias(source_size), F.col("__mix_target").alias(target_), copies.alias(copies_), (F.col("__mix_size") * copies).alias(taken))
