"""Exact Jaccard self-join of documents by word shingles.

The documents are the rows of a sparse incidence matrix, shingles its columns.
Its product with its transpose counts overlaps. The join needs only the entries
that can reach the threshold, and of these only enough to join the classes, so
the product is masked and taken in blocks:

1. Documents with equal shingle sets become one row (copies need no pairs).
2. Size bound: a row of n shingles shares all but n/4 with any partner. So
   among its first n/4 + l columns, in an order that all rows share, at least
   l are a partner's too. Rows that meet other rows in fewer columns go.
3. For the rows left, columns are counted in full. Columns of one row only are
   dropped, rows with too few shared columns go, and the rest of a row is
   ordered from the rarest column on; its first n/4 + 1 columns (those of one
   row only count) hold at least one that any partner has there as well.
4. The mask: a pair is an entry to be counted if one of the two is the head of
   a column that both have there. Heads are the rows whose columns are the most
   common, as the original of a family of near copies is. First each row meets
   only the best of all its heads, which gathers such families; then every
   column's head meets the rows of other components in it and leaves. Columns
   with few pairs of rows in different components are multiplied whole, and
   others go on with twice as many heads each turn, until no column holds two
   components: no pair that could be linked is given up, and none within a
   component is formed.
5. Size-derived bounds discard entries before they are counted: by the sizes of
   both rows, and by the places of the column at which they met, as it is enough
   to see a pair in its first common column. So a pair's smaller row has nearly
   all its columns from there on, and only such rows are heads.
6. The product: rows are cut into blocks of columns; for each block and entry a
   partial overlap count is made, and partial counts are added up.

Hashes have 64 bits. Cases: null and empty texts have no shingles and stand
alone; a text of fewer than five words has one; repeated rows are copies; a
document without an id takes part, and its component is named by the smallest
id there is (null if none); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.components import components
from siltstone.llm.text import SHINGLE, mix, shingle_hashes, utf8, words
from siltstone.shared import discard, release, small_batches, store

EXTRA = 10  # l of step 2: a tenth of the row
SHORT = 8  # a column with so many pairs a row is multiplied whole, as are all columns with so many a row together
COLUMN_BLOCKS = 8
SIZE_CLASSES = 15  # for a size e times as large
FLAGS = 1 << 24  # bits of the map of rows that go on to step 3: 2 MB, whatever the input
BROADCAST_ROWS = 200_000  # rows of two ids


def _small(df: DataFrame) -> DataFrame:
    """A hint to broadcast a stored table of ids, if its checked count allows it."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    flat = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat.view(np.int64)))


def _row(text: bytes | None, size: int) -> tuple[np.ndarray, int | None]:
    """A text's shingles in the common order, and the name of the set."""
    row = np.unique(shingle_hashes(words(text), size))
    return row, (int(np.uint64(xxhash.xxh3_64_intdigest(row.tobytes())).astype(np.int64)) if len(row) else None)


def sizes(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored (doc_id, n, node, first): each row's set size, the name of its set and
    its first columns of step 2, once for equal sets of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, firsts, seen = [], [], [], set()
            for text in utf8(batch.column(1)):
                row, node = _row(text, size)
                names.append(node)
                sizes.append(len(row))
                firsts.append(row[: 0 if node in seen else len(row) // 4 + max(1, len(row) // EXTRA)].copy())  # not a view, which keeps the row
                seen.add(node)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, type=pa.int32()), pa.array(names, type=pa.int64()), _lists(firsts)], names=["doc_id", "n", "node", "first"])

    with small_batches(docs.sparkSession):
        return store(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, n int, node long, first array<long>"), "shingles")


def _met(known: DataFrame) -> DataFrame:
    """(x, node, n): the first columns of all sets. Entries of a column that several
    sets of a batch have are added up there: their sets' rows (x null, n the size and
    the number of them above 32 bits) carry how many, and one entry with n = -1
    tells other batches of the column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            lengths = np.diff(lists.offsets.to_numpy())
            x = lists.flatten().to_numpy(zero_copy_only=False)
            node = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), lengths)
            n = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), lengths)
            if not len(x):
                continue
            order = np.argsort(x, kind="stable")
            same = np.r_[False, x[order][1:] == x[order][:-1]]
            twice = same | np.r_[same[1:], False]
            here = np.zeros(len(x), dtype=bool)
            here[order] = twice
            told = order[twice & ~same]
            names, at, times = np.unique(node[here], return_index=True, return_counts=True)
            alone = np.flatnonzero(~here)
            cols = np.concatenate([x[alone], x[told], np.zeros(len(names), dtype=np.int64)])
            none = np.r_[np.zeros(len(alone) + len(told), dtype=bool), np.ones(len(names), dtype=bool)]
            counts = np.concatenate([n[alone], np.full(len(told), -1), n[here][at] | (times.astype(np.int64) << 32)])
            yield pa.RecordBatch.from_arrays([pa.array(cols, mask=none), pa.array(np.concatenate([node[alone], node[told], names])), pa.array(counts)], names=["x", "node", "n"])

    return known.filter("size(first) > 0").select("n", "node", "first").mapInArrow(run, "x long, node long, n long")


def _flagged(flags: np.ndarray, node: int) -> bool:
    at = int(mix(np.array([node], dtype=np.int64).view(np.uint64))[0]) & (FLAGS - 1)
    return bool(flags[at >> 3] >> (at & 7) & 1)


def _flags(nodes: DataFrame) -> np.ndarray:
    """A bit map of fixed size in which the nodes' bits are set (others may be, too)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(FLAGS, dtype=bool)
        for batch in batches:
            out[(mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) & np.uint64(FLAGS - 1)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(out, bitorder="little").tobytes()], type=pa.binary())], names=["bits"])

    total = np.zeros(FLAGS // 8, dtype=np.uint8)
    for r in nodes.select("node").coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
        total |= np.frombuffer(r["bits"], dtype=np.uint8)
    return total


def _full(docs: DataFrame, size: int, text_col: str, flags: np.ndarray) -> DataFrame:
    """(node, n, row) of every flagged set once. Texts are read again rather than stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, seen = [], set()
            for text in utf8(batch.column(0)):
                row, node = _row(text, size)
                if node is not None and node not in seen and _flagged(flags, node):
                    rows.append((row, node))
                seen.add(node)
            yield pa.RecordBatch.from_arrays([pa.array([k for _, k in rows], type=pa.int64()), pa.array([len(r) for r, _ in rows], type=pa.int32()), _lists([r for r, _ in rows])], names=["node", "n", "row"])

    return docs.select(text_col).mapInArrow(run, "node long, n int, row array<long>").dropDuplicates(["node"])


def _enough(n: Column) -> Column:
    """ceil(3n/4): the least overlap of a row of n shingles with a partner."""
    return F.floor((3 * n + 3) / 4)


def blocks(docs: DataFrame, known: DataFrame, size: int, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Steps 2 and 3: stored rows (node, n, parts: shared columns by block) and
    columns (x, node, n, at, size, common: how common the row's columns are)."""
    met = _met(known)
    # at most one entry from each batch for a column, however common it is
    column = Window.partitionBy("x")
    entries = met.filter("x is not null").withColumns({"low": F.min("node").over(column), "high": F.max("node").over(column), "told": F.min("n").over(column)})
    entries = entries.filter("n > 0 and (told < 0 or low != high)").select("node", "n", F.lit(1).cast("long").alias("mine"))
    added = met.filter("x is null").select("node", F.col("n").bitwiseAND(F.lit(0xFFFFFFFF)).alias("n"), F.shiftright("n", 32).alias("mine"))
    found = entries.unionByName(added)
    least = F.greatest(F.lit(1), F.floor(_enough(F.col("n")) / EXTRA))
    some = store(found.groupBy("node", "n").agg(F.sum("mine").alias("c")).filter(F.col("c") >= least).select("node"), "some")
    with small_batches(docs.sparkSession):
        full = store(_full(docs, size, text_col, _flags(some)).join(some, "node", "left_semi"), "full")
    discard(some)
    counts = full.select(F.explode("row").alias("x")).groupBy("x").agg(F.count("*").alias("rows")).filter("rows > 1")
    common = full.select("node", "n", F.explode("row").alias("x")).join(counts, "x")
    by = common.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("rows", "x"))).alias("by"), F.sum("rows").alias("total")).filter(F.size("by") >= _enough(F.col("n")))
    # of the first n/4 + 1 columns, those that no other row has come first
    front = F.greatest(F.lit(0), F.floor(F.col("n") / 4) + 1 - (F.col("n") - F.size("by"))).cast("int")
    x = F.transform("by", lambda b: b["x"])
    parts = F.transform(F.sequence(F.lit(0), F.lit(COLUMN_BLOCKS - 1)), lambda k: F.filter("x", lambda v: F.pmod(v, F.lit(COLUMN_BLOCKS)) == k))
    rows = by.select("node", "n", F.size("by").alias("size"), (F.col("total") / F.col("n")).alias("common"), front.alias("front"), x.alias("x"))
    rows = store(rows.select("node", "n", "size", "common", F.slice("x", 1, F.col("front")).alias("first"), parts.alias("parts")), "incidence")
    discard(full)
    columns = rows.select("node", "n", "size", "common", F.posexplode("first").alias("at", "x"))
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "node"))
    alike = columns.groupBy("x").agg(F.count("*").alias("rows"), F.min("at").alias("at"), mark(0).alias("m0"), mark(1).alias("m1")).filter("rows > 1")
    kept = alike.groupBy("rows", "m0", "m1").agg(F.min(F.struct("at", "x"))["x"].alias("x"))  # the first in the order
    return rows.select("node", "n", "parts"), store(columns.join(kept, "x", "left_semi"), "columns")


def _overlap_needed(a: Column, b: Column) -> Column:
    """The least overlap of linked rows of these sizes: 100 o >= 75 (a + b - o)."""
    return F.floor((3 * (a + b) + 6) / 7)


def _by_size(columns: DataFrame) -> DataFrame:
    """Columns, split by the size of the smaller row of a pair: x stands for a column
    and a class of sizes; rows stand in all classes that a partner's size may have
    there, and are ``wide`` in that of their own size."""
    step = lambda n: F.floor(F.log(n) * SIZE_CLASSES).cast("int")
    n, left = F.col("n"), F.col("size") - F.col("at")
    low, high = F.floor((3 * n + 3) / 4), F.least(F.floor(4 * n / 3), F.floor(7 * left / 3) - n)
    each = columns.filter(high >= low).withColumn("class", F.explode(F.sequence(step(low), step(high))))
    return each.withColumns({"x": F.xxhash64("x", "class"), "wide": F.expr(WIDE) & (F.col("class") == step(n))}).drop("class")


# Step 5. A pair needs to be seen only in its first common column: what is at ``at``
# of ``size`` columns there leaves size - at columns at most to have in common.
WIDE = "7 * (size - at) >= 6 * n"  # the smaller row of a linked pair is wide, as its overlap is 6/7 of it or more


def _possible(one: str, two: str) -> Column:
    """Whether two rows (structs with n, at, size) can be linked by a column of both."""
    n = lambda f: (F.col(f"{one}.{f}"), F.col(f"{two}.{f}"))
    (na, nb), (ia, ib), (sa, sb) = n("n"), n("at"), n("size")
    return (4 * F.least(na, nb) >= 3 * F.greatest(na, nb)) & (F.least(sa - ia, sb - ib) >= _overlap_needed(na, nb))


def counted(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Step 6: the stored pairs (a, b, need) whose overlap is at least ``need``."""
    some = rows.join(_small(pairs).withColumnRenamed("b", "node"), "node").select("a", F.col("node").alias("b"), "need", F.posexplode("parts").alias("block", "xb"))
    heads = rows.join(_small(store(pairs.select(F.col("a").alias("node")).distinct(), "heads")), "node", "left_semi").select(F.col("node").alias("a"), F.posexplode("parts").alias("block", "xa"))
    partial = some.join(heads, ["a", "block"]).select("a", "b", "need", F.size(F.array_intersect("xa", "xb")).alias("o"))
    return store(partial.groupBy("a", "b", "need").agg(F.sum("o").alias("o")).filter("o >= need").select("a", "b"), "links")


def _grown(comps: DataFrame | None, new: DataFrame) -> DataFrame:
    """Components with further links: only what the links join is worked out anew."""
    if comps is None:
        return components(new)
    known = lambda side: comps.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}"))
    both = new.join(known("a"), "a", "left").join(known("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = components(both).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    nodes = new.select(F.col("a").alias("node")).unionByName(new.select(F.col("b").alias("node"))).distinct().join(comps, "node", "left_anti")
    every = comps.unionByName(nodes.withColumn("comp", F.col("node")))
    return store(every.join(merged, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "comps")


def link(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """(node, comp) of all rows that are linked to others: steps 4 to 6."""
    linear = SHORT * columns.count()
    columns = store(_by_size(columns), "classes")
    own = F.struct("common", "node", "n", "at", "size")
    need = _overlap_needed(F.col("n"), F.col("head.n")).alias("need")
    # each row and the best of its heads
    heads = columns.filter("wide").groupBy("x").agg(F.max(own).alias("head"))
    met = columns.join(heads, "x").withColumn("own", own).filter((F.col("node") != F.col("head.node")) & _possible("own", "head"))
    best = met.groupBy("node", "n").agg(F.max("head").alias("head")).select(F.col("head.node").alias("a"), F.col("node").alias("b"), need)
    tried = store(best, "pairs")
    links = counted(tried, rows)
    comps = None if links.isEmpty() else _grown(None, links)
    turn, done = 0, False
    while not done:
        turn += 1
        now = columns.withColumn("comp", F.col("node")) if comps is None else columns.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        now = store(now.select("x", "node", "n", "at", "size", "common", "wide", "comp"), "turn")
        own = F.struct("common", "node", "n", "at", "size", "comp")
        by_comp = now.groupBy("x", "comp").agg(F.count("*").alias("n"), F.count_if("wide").alias("w"), F.max(F.when(F.col("wide"), own)).alias("head"))
        live = by_comp.groupBy("x").agg(F.sum(F.col("n") * F.col("w")).alias("within"), F.sum("n").alias("rows"), F.sum("w").alias("w"), F.max("head").alias("head"))
        live = store(live.select("x", "rows", "head", (F.col("rows") * F.col("w") - F.col("within")).alias("pairs")).filter("pairs > 0"), "live")
        pairs_left = live.agg(F.sum("pairs")).collect()[0][0]
        if pairs_left is None:
            break
        done = pairs_left <= linear
        if turn == 1 and not done:
            heads = live.select("x", "head")
            left = now.join(heads, "x").filter(F.col("node") != F.col("head.node"))
        else:
            whole = F.lit(done) | (F.col("pairs") <= SHORT * F.col("rows"))
            lane = F.when(whole, F.col("node")).otherwise(F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(1 << min(max(turn - 2, 0), 40))))
            heads = now.filter("wide").join(live.select("x", "rows", "pairs"), "x").groupBy("x", lane.alias("lane")).agg(F.max(own).alias("head")).select("x", "head")
            if not done:
                heads = store(heads, "heads")
                left = now.join(live.filter(~whole).select("x"), "x", "left_semi").join(heads.select("x", F.col("head.node").alias("node")), ["x", "node"], "left_anti")
        met = now.join(heads, "x").withColumn("own", own).filter((F.col("comp") != F.col("head.comp")) & _possible("own", "head"))
        pairs = met.select(F.least("node", "head.node").alias("b"), F.greatest("node", "head.node").alias("a"), need).distinct()
        before = tried.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a"))
        pairs = store(pairs.join(before, ["a", "b"], "left_anti").select("a", "b", "need"), "pairs")
        links = counted(pairs, rows)
        if not links.isEmpty():
            comps = _grown(comps, links)
        tried = tried.unionByName(pairs)
        if not done:
            columns = store(left.select("x", "node", "n", "at", "size", "common", "wide"), "columns")
        discard(now, live)
    if comps is None:
        return rows.select("node", F.col("node").alias("comp")).limit(0)
    return comps


def join(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``."""
    first = sizes(docs, size, id_col, text_col)
    rows, columns = blocks(docs, first, size, text_col)
    release(docs.sparkSession)
    comps = link(rows, columns)
    release(docs.sparkSession)
    own = first.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    named = own.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    by_node = named.join(names, "comp").select("node", "component_id")
    n = F.col("n").cast("long").alias("n_shingles")
    some = first.filter("n > 0").select("doc_id", n, "node").join(by_node, "node").select("doc_id", "n_shingles", "component_id")
    return some.unionByName(first.filter("n = 0").select("doc_id", n, F.col("doc_id").alias("component_id")))
