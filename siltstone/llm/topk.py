"""Exact top-k search by inner product: tiled matrix products.

Vectors become integers floor(1024 x). Queries of a bounded number of bytes are
broadcast to all tasks; each task multiplies tiles of its own vectors with tiles
of the queries, keeps the best of each query over its tiles, and these short
lists are merged in two levels. A tile's matrix of scores is bounded in bytes,
too. Only where there are more queries than one broadcast holds, vectors are
read once more for each further one.

Every row is a candidate, so a query's list has one row more than asked for; the
query's own row is then taken out of it, if it got there.

Cases: vectors that are null, or hold null or non-finite components, take no
part, nor do rows without an id; vectors meet queries of the same length only;
ties go to the smaller id; fewer than k candidates give fewer rows; an empty
table gives no rows; if a query's id occurs on several rows, each is a query
and a candidate for the others; other repeated rows are candidates each; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.shared import store

SCALE = 1024
QUERY_BYTES = 64 << 20  # of the queries that are broadcast at once
SCORE_BYTES = 16 << 20  # of the scores of a tile
TILE = 4_096  # vectors
EXACT = float(2**53)


def _usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def _tile(ids: np.ndarray, tile: np.ndarray, block: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's index, id, score) of at least the k best of each query."""
    n = len(ids)
    largest = np.abs(tile).max(initial=0) * np.abs(block).max(initial=0) * max(1, tile.shape[1])
    if largest < EXACT:
        scores = block @ tile.T  # float64 holds these integers exactly
    else:
        low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        exact = np.array([[int(v) for v in row] for row in block.tolist()], dtype=object) @ np.array([[int(v) for v in row] for row in tile.tolist()], dtype=object).T
        scores = np.clip(exact, low, high).astype(np.int64)
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k]
        query, row = np.nonzero(scores >= least[:, None])
    else:
        query, row = np.divmod(np.arange(scores.size), max(1, n))
    return query, ids[row], scores[query, row].astype(np.int64)


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, ~scores, query))  # ~s orders as -s, without overflow
    query, ids, scores = query[order], ids[order], scores[order]
    first = np.r_[True, query[1:] != query[:-1]] if len(query) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    keep = rank < k
    return query[keep], ids[keep], scores[keep]


def _searcher(shared: Broadcast, k: int):
    """shared: by length of vectors, the queries' numbers and a matrix of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, kept = shared.value, {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.r_[0, np.cumsum(lengths)]
            for size in np.unique(lengths).tolist():
                if size not in blocks:
                    continue
                queries = blocks[size][1]
                step = max(1, SCORE_BYTES // (8 * TILE))
                rows = np.flatnonzero(lengths == size)
                for i in range(0, len(rows), TILE):
                    some = rows[i : i + TILE]
                    values = flat[starts[some][:, None] + np.arange(size)[None, :]] if size else np.zeros((len(some), 0))
                    tile = np.floor(SCALE * values.astype(np.float64))
                    for q in range(0, len(queries), step):
                        found = _tile(ids[some], tile, queries[q : q + step], k)
                        if (size, q) in kept:
                            found = tuple(np.concatenate(x) for x in zip(kept[size, q], found, strict=True))
                        kept[size, q] = _best(*found, k)
        for (size, q), (query, ids, scores) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(blocks[size][0][query + q]), pa.array(ids), pa.array(scores)], names=["query", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row with ``is_query``: query_id, rank, vec_id, score of its k best others."""
    context = vectors.sparkSession.sparkContext
    usable = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
    usable = usable.filter(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    queries = store(usable.filter("q").select(F.monotonically_increasing_id().alias("query"), "vec_id", "v"), "queries")
    total = queries.agg(F.sum(8 * F.size("v") + 16)).collect()[0][0] or 0
    passes = max(1, -(-total // QUERY_BYTES))
    parts = []
    for i in range(passes):
        rows = queries.filter(F.pmod(F.xxhash64("query"), F.lit(passes)) == i) if passes > 1 else queries
        by: dict[int, list] = {}
        for r in rows.select("query", "v").toLocalIterator():  # of bounded size
            by.setdefault(len(r["v"]), []).append((r["query"], np.array(r["v"], dtype=np.float64)))
        blocks = {d: (np.array([x[0] for x in own], dtype=np.int64), np.floor(SCALE * np.array([x[1] for x in own])).reshape(len(own), d)) for d, own in by.items()}
        shared = context.broadcast(blocks)
        found = usable.select("vec_id", "v").mapInArrow(_searcher(shared, k + 1), "query long, vec_id long, score long").withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(16)))
        best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
        lanes = found.withColumn("r", best("query", "lane")).filter(F.col("r") <= k + 1)
        part = lanes.withColumn("r", best("query")).filter(F.col("r") <= k + 1)
        if passes > 1:
            part = store(part, "top")
            shared.destroy()
        parts.append(part)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    # the own row, if it is in the list, stands at one of the places of its id and score
    whole = F.transform("v", lambda x: F.floor(SCALE * x))
    product = F.aggregate(whole, F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x.cast("decimal(19,0)") * x).cast("decimal(38,0)"))
    high = F.lit(2**63 - 1).cast("decimal(38,0)")
    own = queries.select("query", F.col("vec_id").alias("query_id"), F.least(product, high).cast("long").alias("self"))
    both = found.join(own, "query")
    mine = F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("self")), F.col("r"))
    both = both.withColumn("mine", F.min(mine).over(Window.partitionBy("query"))).filter(F.col("mine").isNull() | (F.col("r") != F.col("mine")))
    rank = (F.col("r") - F.when(F.col("r") > F.col("mine"), 1).otherwise(0)).cast("int")
    return both.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
