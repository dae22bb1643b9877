"""Hard negatives from candidate lists that the anchors of a cluster share.

For each anchor the best rows of its own label are its positives; for each
positive the best rows of other labels that score within a share of its score
are the negatives. Scores are inner products of integer vectors.

Anchors are clustered by direction. For a cluster, whose anchors lie within an
angle of its centre, no anchor a scores more with a candidate c than
|a| |c| cos(max(0, angle(c, centre) - that angle)). Each block of candidates is
sorted by that bound once for the cluster, and every anchor of the cluster walks
down the same list, some steps of all its anchors at a time, until the bound
certifies that nothing further down can enter its lists: for positives at the
worst score it holds, for negatives at the larger of that and the least score
that is still hard. Lists carry over from block to block of a task, so later
blocks end sooner; the short lists of all tasks are merged in two levels.

Anchors are broadcast in groups of bounded bytes; only where there are more of
them, the candidates are read once more for each further group. What a centre
decides is only the order of the walk: any clustering gives the same rows.

Cases: rows take no part whose id, label or vector is null, or whose vector
holds null or non-finite components; vectors meet those of the same length only;
ties go to the smaller id; an anchor with fewer positives, or a positive with
fewer negatives, has fewer rows; rows with one id are rows of their own, each an
anchor and a candidate for the others; an empty table gives no rows; other
columns are ignored. Where sums of products reach 2^53, every score is computed
with unbounded integers and nothing is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.shared import store

ANCHOR_BYTES = 32 << 20  # of the anchors that are broadcast at once
BLOCK = 8_192  # candidates that are sorted together
STEP = 256  # steps that the anchors of a cluster walk at once
CLUSTERED = 32  # anchors of a cluster, about
ROUNDS = 4  # of the clustering
LANES = 16
EXACT = float(2**53)
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def clusters(vectors: np.ndarray, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(rows, unit centre, largest angle) of clusters of vectors by direction."""
    norms = np.linalg.norm(vectors, axis=1)
    unit = vectors / np.where(norms > 0, norms, 1)[:, None]
    k = max(1, len(vectors) // CLUSTERED)
    centres = unit[np.random.default_rng(seed).choice(len(unit), k, replace=False)]
    for turn in range(ROUNDS):
        own = np.concatenate([np.argmax(unit[i : i + BLOCK] @ centres.T, axis=1) for i in range(0, len(unit), BLOCK)])
        if turn < ROUNDS - 1:
            sums = np.zeros_like(centres)
            np.add.at(sums, own, unit)
            size = np.linalg.norm(sums, axis=1)
            centres = np.where(size[:, None] > 0, sums / np.where(size > 0, size, 1)[:, None], centres)
    out = []
    for c in np.unique(own).tolist():
        rows = np.flatnonzero(own == c)
        angles = np.arccos(np.clip(unit[rows] @ centres[c], -1, 1))
        angles[norms[rows] == 0] = 0  # any angle would do: it scores zero with all
        out.append((rows, centres[c], float(angles.max())))
    return out


def _scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors, exact; clipped to 64 bits."""
    if np.abs(a).max(initial=0) * np.abs(c).max(initial=0) * max(1, a.shape[1]) < EXACT:
        return (a @ c.T).astype(np.int64)  # float64 holds these integers exactly
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)
    return np.clip(whole(a) @ whole(c).T, LOW, HIGH).astype(np.int64)


class _Lists:
    """The best (score, id, row) of each of n takers so far."""

    def __init__(self, n: int, k: int) -> None:
        self.scores, self.ids, self.rows = np.full((n, k), LOW), np.zeros((n, k), np.int64), np.full((n, k), -1)

    def worst(self, takers: np.ndarray) -> np.ndarray:
        """The score that a row must reach to enter; the least number while there is room."""
        full = self.rows[takers, -1] >= 0
        return np.where(full, self.scores[takers, -1], LOW)

    def take(self, takers: np.ndarray, scores: np.ndarray, good: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Offers each taker the candidates that are good for it and reach its worst."""
        k = self.ids.shape[1]
        i, j = np.nonzero(good & (scores >= self.worst(takers)[:, None]))
        if not len(i):
            return
        have = self.rows[takers] >= 0
        i2, j2 = np.nonzero(have)
        who = np.r_[i, i2]
        s, v, r = np.r_[scores[i, j], self.scores[takers[i2], j2]], np.r_[ids[j], self.ids[takers[i2], j2]], np.r_[rows[j], self.rows[takers[i2], j2]]
        order = np.lexsort((r, v, ~s, who))  # ~s orders as -s, without overflow
        who, s, v, r = who[order], s[order], v[order], r[order]
        heads = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        nth = np.arange(len(who)) - np.repeat(heads, np.diff(np.r_[heads, len(who)]))
        on = nth < k
        at, nth = takers[who[on]], nth[on]
        self.scores[at, nth], self.ids[at, nth], self.rows[at, nth] = s[on], v[on], r[on]


def _walk(block: dict, group: dict, lists: _Lists, low: np.ndarray | None, high: np.ndarray | None) -> int:
    """Walks the anchors of all clusters down their shared lists of one block of
    candidates; low and high are the bounds of what each taker takes, for negatives,
    which are of other labels. Returns how many scores were computed."""
    per = 1 if low is None else low.shape[1]  # takers of an anchor
    c, norms, steps = block["v"], block["norms"], 0
    exact = group["largest"] * np.abs(c).max(initial=0) * max(1, c.shape[1]) < EXACT
    for members, centre, widest in group["clusters"]:
        with np.errstate(invalid="ignore", divide="ignore"):
            angle = np.arccos(np.clip(np.nan_to_num(c @ centre / norms), -1, 1))
        bound = norms * np.cos(np.maximum(0, angle - widest))
        order = np.argsort(-bound)
        bound, left = bound[order], members
        for at in range(0, len(order), STEP):
            takers = (left[:, None] * per + np.arange(per)).ravel()
            if exact:
                worst = lists.worst(takers).astype(np.float64)
                if low is not None:
                    worst = np.maximum(worst, low[left].ravel())
                # a little more than the bound, for the rounding of angles and norms
                most = np.repeat(group["norms"][left], per)
                most = np.maximum(most * bound[at], 0) * (1 + 1e-6) + most * norms.max(initial=0) * 1e-6 + 1e-6
                on = (most >= worst).reshape(-1, per).any(axis=1)
                left = left[on]
                if not len(left):
                    break
                takers = (left[:, None] * per + np.arange(per)).ravel()
            some = order[at : at + STEP]
            steps += len(some) * len(left)
            scores = _scores(group["v"][left], c[some])
            same = group["labels"][left][:, None] == block["labels"][some][None, :]
            if low is None:
                good = same & (group["rows"][left][:, None] != block["rows"][some][None, :])
            else:
                scores, same = np.repeat(scores, per, axis=0), np.repeat(same, per, axis=0)
                good = ~same & (scores >= low[left].reshape(-1, 1)) & (scores <= high[left].reshape(-1, 1))
            lists.take(takers, scores, good, block["ids"][some], block["rows"][some])
    return steps


def _walker(shared, k: int, negatives: bool):
    """Over rows (row, id, label, v): the k best of each taker in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = shared.value
        lists = {d: _Lists(len(g["v"]) * (g["low"].shape[1] if negatives else 1), k) for d, g in groups.items()}
        for batch in batches:
            rows, ids, labels = (batch.column(x).to_numpy(zero_copy_only=False) for x in range(3))
            lengths = np.diff(batch.column(3).offsets.to_numpy())
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            starts = np.r_[0, np.cumsum(lengths)]
            for d in np.unique(lengths).tolist():
                if d not in groups:
                    continue
                own = np.flatnonzero(lengths == d)
                for i in range(0, len(own), BLOCK):
                    some = own[i : i + BLOCK]
                    v = np.floor(groups[d]["scale"] * flat[starts[some][:, None] + np.arange(d)[None, :]])
                    block = {"v": v, "norms": np.linalg.norm(v, axis=1), "ids": ids[some], "rows": rows[some], "labels": labels[some]}
                    g = groups[d]
                    _walk(block, g, lists[d], g["low"] if negatives else None, g["high"] if negatives else None)
        for d, own in lists.items():
            i, j = np.nonzero(own.rows >= 0)
            per = groups[d]["low"].shape[1] if negatives else 1
            yield pa.RecordBatch.from_arrays([pa.array(groups[d]["rows"][i // per]), pa.array((i % per + 1).astype(np.int32)), pa.array(own.ids[i, j]), pa.array(own.scores[i, j]), pa.array(own.rows[i, j])], names=["anchor", "place", "id", "score", "row"])

    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and place, with their rank: by lanes of tasks, then in all."""
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id", "row"))
    lanes = found.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(LANES)))
    lanes = lanes.withColumn("rank", best("anchor", "place", "lane")).filter(F.col("rank") <= k)
    return lanes.withColumn("rank", best("anchor", "place")).filter(F.col("rank") <= k).drop("lane")


def _group(anchors: list, scale: int, bounds: tuple[np.ndarray, np.ndarray] | None = None) -> dict:
    """By length of vectors: what tasks need of some anchors (row, label, v)."""
    by: dict[int, list[int]] = {}
    for n, r in enumerate(anchors):
        by.setdefault(len(r["v"]), []).append(n)
    out = {}
    for d, own in by.items():
        v = np.floor(scale * np.array([anchors[n]["v"] for n in own], dtype=np.float64).reshape(len(own), d))
        rows, labels = (np.array([anchors[n][x] for n in own], dtype=np.int64) for x in ("row", "label"))
        out[d] = {"v": v, "scale": scale, "norms": np.linalg.norm(v, axis=1), "largest": np.abs(v).max(initial=0), "clusters": clusters(v), "rows": rows, "labels": labels}
        if bounds is not None:
            out[d] |= {"low": bounds[0][own], "high": bounds[1][own]}
    return out


def mine(vectors: DataFrame, is_anchor: Column, label: Column, k_positive: int = 5, k_negative: int = 5, share: tuple[int, int] = (80, 100), scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for
    each anchor's ``k_positive`` best rows of its label the ``k_negative`` best rows of
    other labels with share[0] * positive <= share[1] * negative <= share[1] * positive."""
    spark = vectors.sparkSession
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad))
    # numbered once and written, so that both walks know a row by the same number
    rows = store(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "v", "is_anchor"), "negatives-rows")
    anchors, candidates = rows.filter("is_anchor"), rows.select("row", "id", "label", "v")
    total = anchors.agg(F.sum(8 * F.size("v") + 8 * k_positive * (k_negative + 1) * 3 + 64)).collect()[0][0] or 0
    passes = max(1, -(-total // ANCHOR_BYTES))
    schema, parts = "anchor long, place int, id long, score long, row long", []
    for turn in range(passes):
        some = anchors.filter(F.pmod(F.xxhash64("row"), F.lit(passes)) == turn) if passes > 1 else anchors
        own = list(some.select("row", "label", "v").toLocalIterator())  # of bounded bytes
        first = spark.sparkContext.broadcast(_group(own, scale))
        positives = store(_merged(candidates.mapInArrow(_walker(first, k_positive, False), schema), k_positive).select("anchor", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
        first.destroy()
        place = {r["row"]: n for n, r in enumerate(own)}
        low, high = np.full((len(own), k_positive), HIGH), np.full((len(own), k_positive), LOW)  # none, where there is no positive
        for r in positives.select("anchor", "rank", "positive_score").toLocalIterator():  # k for each of those anchors
            score = r["positive_score"]
            least = -(-share[0] * score // share[1])
            if least <= score:
                low[place[r["anchor"]], r["rank"] - 1], high[place[r["anchor"]], r["rank"] - 1] = least, score
        second = spark.sparkContext.broadcast(_group(own, scale, (low, high)))
        found = _merged(candidates.mapInArrow(_walker(second, k_negative, True), schema), k_negative)
        told = found.select("anchor", F.col("rank").alias("nth"), F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(positives, ["anchor", "rank"])
        if passes > 1:
            told = store(told, "negatives-found")
            second.destroy()
        parts.append(told)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    named = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return found.join(named, "anchor").select("anchor_id", "positive_id", F.col("nth").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
