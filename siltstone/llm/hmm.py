"""Hidden Markov language model, trained by Baum-Welch across partitions.

Words are counted over all training texts, and every word of them has an emission
probability of its own in each state. Those of the most frequent words (the head)
are held in tables in the tasks; those of all others are a stored table that grows
with the vocabulary and that is joined to the texts, by word. One further symbol
stands for all unseen words, so the model is a proper distribution.

Each round of Baum-Welch runs the scaled forward and backward recursions over
all training texts and adds up expected counts across partitions. In all rounds
but the last, words outside the head share one symbol, within which each has the
same share in every state; the last round counts each of them by state. (The share
cancels in what is expected, so every round is an exact one for its model.) Only
tables of states x head come to the driver. Counts are rounded to 2^-16 before
they are added, so that sums do not depend on their order.

States begin as groups of training texts, of all of them: first by a random
direction for each word of the head, then once more by the words of these groups.

Scores are the exact likelihood by the scaled forward recursion. Long texts of
several batches are taken together, in spans: forward variables are kept where spans
begin, and computed again from there on the way back.

Cases: a null text is empty and has the end token only; repeated rows count and
are scored each; without training texts all counts are 0 and every word is
unseen; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.text import utf8, words
from siltstone.shared import discard, release, small_batches, store

STATES, HEAD, ROUNDS = 8, 32_768, 3
END, TAIL, FIRST = 0, 1, 2  # ids: the end token, words outside the head, the head
FLUSH = 400_000  # distinct words that a task holds while counting
CELLS = 1 << 17  # words in a block of texts that the recursions take at once
BATCH = 2 << 20  # bytes of Arrow batches
SPAN = 1 << 17  # words of long texts whose variables are held at once
LONG, GROUP = 512, 1 << 20  # tokens: longer texts of several batches are taken together, so many at once
ROWS, WIDE = 64, 1 << 21  # long texts in a block, and words in it
UNIT = 65_536.0  # expected counts are multiples of 1 / UNIT
SCALED = 8  # forward variables are scaled at every so many steps and where a text ends
SHARES = 255  # parts of a rare word's occurrences, as states share them
PRIOR = 200.0  # weight, in words, of the overall distribution in each state's


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Stored (word, c); the end token is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in utf8(batch.column(0)):
                found.update(words(text))
                found[b""] += 1
                if len(found) > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), type=pa.binary()), pa.array(list(found.values()), type=pa.int64())], names=["word", "c"])
                    found = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), type=pa.binary()), pa.array(list(found.values()), type=pa.int64())], names=["word", "c"])

    parts = docs.select(F.col(text_col)).mapInArrow(run, "word binary, c long")
    return store(parts.groupBy("word").agg(F.sum("c").alias("c")), "hmm-counts")


def _kind(symbols: int) -> str:
    """How ids are held in bytes: whole columns of these pass Spark without a look at each."""
    return "<u2" if symbols <= 1 << 16 else "<u4"


def _lists(column: pa.Array, symbols: int) -> pa.ListArray:
    """The ids of each text."""
    kind = np.dtype(_kind(symbols))
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1] // kind.itemsize if len(column) else np.zeros(1, dtype=np.int32)
    values = np.frombuffer(column.buffers()[2], dtype=kind, count=int(offsets[-1]))[offsets[0] :] if len(column) else np.empty(0)
    return pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(values.astype(np.int32)))


def _regrouped(batches: Iterator[pa.RecordBatch], column: int, symbols: int) -> Iterator[pa.RecordBatch]:
    """The same rows, with long texts of several batches in one: a step of the recursions costs
    much the same for one text as for many."""
    kept, held = [], 0
    for batch in batches:
        size = np.diff(_lists(batch.column(column), symbols).offsets.to_numpy())
        yield batch.filter(pa.array(size <= LONG))
        kept.append(batch.filter(pa.array(size > LONG)))
        held += int(size[size > LONG].sum())
        if held > GROUP:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
            kept, held = [], 0
    if held:
        yield from pa.Table.from_batches(kept).combine_chunks().to_batches()


def encode(docs: DataFrame, head: dict[bytes, int], text_col: str = "text") -> DataFrame:
    """Stored ``docs`` with ids (of head words, as bytes) and tail (other words), without the text."""
    spark = docs.sparkSession
    ids_of = spark.sparkContext.broadcast(head)
    names = [c for c in docs.columns if c != text_col]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", ids binary, tail array<binary>"
    kind = _kind(FIRST + len(head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = ids_of.value.get
        for batch in batches:
            ids, tails = [], []
            for text in utf8(batch.column(len(names))):
                found = words(text)
                own = [get(w, TAIL) for w in found]
                tails.append([w for w, i in zip(found, own, strict=True) if i == TAIL])
                own.append(END)
                ids.append(np.array(own, dtype=kind).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, type=pa.binary()), pa.array(tails, type=pa.list_(pa.binary()))], names=[*names, "ids", "tail"])

    out = store(docs.select(*names, text_col).mapInArrow(run, schema), "hmm-encoded")
    ids_of.destroy()
    return out


@dataclass
class Model:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # ids x K

    @cached_property
    def by_state(self) -> np.ndarray:
        return np.ascontiguousarray(self.emit.T)


def _blocks(lists: pa.ListArray, flat: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their lengths, ids as steps x rows) of texts of similar length, longest
    first. ``flat`` takes the place of the lists' values."""
    lengths = np.diff(lists.offsets.to_numpy())
    if flat is None:
        flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.r_[0, np.cumsum(lengths)][:-1]
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        steps = int(lengths[order[at]])
        rows = order[at : at + max(1, CELLS // max(1, steps), min(ROWS, WIDE // max(1, steps)))]
        at += len(rows)
        size = lengths[rows]
        ids = np.zeros((steps, len(rows)), dtype=np.int32)
        t = np.arange(steps)[:, None]
        live = t < size[None, :]
        ids[live] = flat[(starts[rows][None, :] + t)[live]]
        yield rows, size, ids


def _forward(model: Model, size: np.ndarray, ids: np.ndarray, begin: int = 0, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward variables and emissions (states x steps x texts), scales (1 past a text's end and
    where nothing is scaled) and live texts by step, for the steps from ``begin`` on, with the variables
    ``before`` them."""
    steps, n = ids.shape
    live = np.searchsorted(-size, -np.arange(begin, begin + steps), side="left")  # texts longer than t, as the longest come first
    emit, move = np.empty((len(model.start), steps, n)), np.ascontiguousarray(model.move.T)
    for own, values in zip(emit, model.by_state, strict=True):
        np.take(values, ids, out=own, mode="clip")  # all ids are there; what other modes check costs a copy
    alpha = np.zeros_like(emit)
    scale = np.ones((steps, n))
    last = before
    counts = [*live.tolist(), int(np.searchsorted(-size, -(begin + steps), side="left"))]
    for t in range(steps):
        m, on = counts[t], counts[t + 1]
        own = alpha[:, t, :m]
        if last is None:
            np.multiply(emit[:, t, :m], model.start[:, None], out=own)
        else:
            np.multiply(move @ last[:, :m], emit[:, t, :m], out=own)
        if t % SCALED == SCALED - 1 or t == steps - 1:
            on = 0
        if on < m:
            own[:, on:].sum(axis=0, out=scale[t, on:m])
            own[:, on:] /= scale[t, on:m]
        last = own
    return alpha, emit, scale, live


def _likely(model: Model, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """log10 of each text's likelihood."""
    total, last = np.zeros(len(size)), None
    span = max(1, SPAN // len(size))  # nothing but the last step is kept
    for begin in range(0, len(ids), span):
        alpha, _, scale, _ = _forward(model, size, ids[begin : begin + span], begin, last)
        total += np.log10(scale).sum(axis=0)
        last = alpha[:, -1].copy()
    return total


def _expected(model: Model, size: np.ndarray, ids: np.ndarray, into: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Adds the expected starts, moves and emissions of a block of texts."""
    start, move, counts = into
    k = len(model.start)
    span = max(1, SPAN // len(size))
    begins, lasts = list(range(0, len(ids), span)), [None]
    for begin in begins[:-1]:
        lasts.append(_forward(model, size, ids[begin : begin + span], begin, lasts[-1])[0][:, -1].copy())
    after, follow = None, 0  # what the next span's first step is worth, and the texts that reach it
    for begin, last in zip(reversed(begins), reversed(lasts), strict=True):
        alpha, ahead, scale, live = _forward(model, size, ids[begin : begin + span], begin, last)
        part = np.zeros_like(alpha)  # of each state at each step; 0 past a text's end
        steps = alpha.shape[1]
        for t, m in zip(range(steps - 1, -1, -1), reversed(live.tolist()), strict=True):
            if follow == m and after is not None:
                beta = model.move @ after
            else:
                beta = np.ones((k, m))
                if after is not None:
                    beta[:, :follow] = model.move @ after[:, :follow]
            np.multiply(beta, alpha[:, t, :m], out=part[:, t, :m])
            if t % SCALED == SCALED - 1 or t == steps - 1 or follow < m:
                beta /= scale[t, :m]
            after, follow = ahead[:, t, :m], m
            after *= beta  # so far the emissions
            if m < len(size):
                ahead[:, t, m:] = 0
        after = after.copy()
        if steps > 1:
            move += model.move * (alpha[:, :-1].reshape(k, -1) @ ahead[:, 1:].reshape(k, -1).T)
        if last is not None:
            move += model.move * (last @ ahead[:, 0].T)
        if begin == 0:
            start += part[:, 0].sum(axis=1)
        flat = ids[begin : begin + span].ravel().astype(np.intp)
        for j in range(k):
            counts[:, j] += np.bincount(flat, weights=part[j].ravel(), minlength=len(counts))


def _rows(word: pa.Array, row: np.ndarray, n: np.ndarray, g: np.ndarray) -> pa.RecordBatch:
    """Added counts by head id, or by word; whole multiples of 1 / UNIT add up alike in any order."""
    g = np.rint(g * UNIT) / UNIT
    names = ["row", "word", "n", *(f"g{j}" for j in range(g.shape[1]))]
    return pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), word, pa.array(n.astype(np.int64)), *(pa.array(g[:, j].copy()) for j in range(g.shape[1]))], names=names)


def _sums(encoded: DataFrame, model: Model, by_word: bool) -> DataFrame:
    """Expected counts over all rows of ``encoded`` (columns ids, tail), as rows of
    (row, word, n, g0, ...): emissions of the head by id, then moves, then starts.
    ``by_word``: words outside the head each, with their occurrences, in place of id TAIL."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    symbols, k = model.emit.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        total = np.zeros(k), np.zeros((k, k)), np.zeros((k, symbols)).T
        for batch in _regrouped(batches, 0, symbols):
            lists, own, flat, here = _lists(batch.column(0), symbols), total[2], None, model
            if by_word:
                coded = batch.column(1).flatten().dictionary_encode()
                which = coded.indices.to_numpy()
                flat = lists.flatten().to_numpy(zero_copy_only=False).copy()
                flat[flat == TAIL] = symbols + which
                found = len(coded.dictionary)
                own = np.zeros((k, symbols + found)).T
                here = Model(model.start, model.move, np.concatenate([model.emit, np.repeat(model.emit[TAIL : TAIL + 1], found, axis=0)]))
            for _, size, ids in _blocks(lists, flat):
                _expected(here, size, ids, (total[0], total[1], own))
            if by_word:
                np.add(total[2], own[:symbols], out=total[2])
                yield _rows(coded.dictionary, np.full(found, TAIL), np.bincount(which, minlength=found), own[symbols:])
        rows = np.concatenate([total[2], total[1], total[0][None, :]])
        some = np.flatnonzero(rows.sum(axis=1))
        yield _rows(pa.nulls(len(some), pa.binary()), some, np.zeros(len(some)), rows[some])

    fields = [f"g{j}" for j in range(k)]
    parts = encoded.select("ids", "tail").mapInArrow(run, "row int, word binary, n long, " + ", ".join(f"{f} double" for f in fields))
    return parts.groupBy("row", "word").agg(F.sum("n").alias("n"), *(F.sum(f).alias(f) for f in fields))


def _fetch(sums: DataFrame, symbols: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emissions of the head, moves and starts: at most head x states numbers."""
    added = sums.filter("word is null").toArrow()
    rows = np.zeros((symbols + k + 1, k))
    for j in range(k):
        rows[added["row"].to_numpy(), j] = added[f"g{j}"].to_numpy()
    move, start = rows[symbols:-1] + 1.0, rows[-1] + 1.0
    return rows[:symbols], move / move.sum(axis=1, keepdims=True), start / start.sum()


def baum_welch(encoded: DataFrame, model: Model, prior: np.ndarray) -> Model:
    """One round over all rows of ``encoded``, with one symbol for words outside the head."""
    counts, move, start = _fetch(_sums(encoded, model, False), *model.emit.shape)
    # every symbol keeps an occurrence of its own, shared among the states by their weight
    emit = counts + PRIOR * prior[:, None] + counts.sum(axis=0) / max(1.0, counts.sum())
    return Model(start, move, emit / emit.sum(axis=0))


@dataclass
class Smoothing:
    """Emissions from expected counts g and occurrences c: (g + PRIOR * (c + 1) / n + weight) / total."""

    n: float  # occurrences of all symbols, one more for each
    weight: np.ndarray  # K
    total: np.ndarray  # K

    def emissions(self, g: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (g + PRIOR * (c[:, None] + 1) / self.n + self.weight) / self.total


def last_round(encoded: DataFrame, model: Model, known: np.ndarray, symbols: int) -> tuple[Model, Smoothing, DataFrame]:
    """A round that counts every word by itself: the model, in which id TAIL now stands for
    unseen words, and a stored (word, c, parts0, ...) of words outside the head: these longs have, in bytes,
    the states' parts of c in 255ths, and totals are of these parts, so probabilities add up to 1.
    ``known``: occurrences by id, ``symbols``: number of words, end and unseen words included."""
    k = model.emit.shape[1]
    sums = store(_sums(encoded, model, True), "hmm-sums")
    counts, move, start = _fetch(sums, *model.emit.shape)
    packed = [F.shiftleft(F.least(F.rint(F.col(f"g{j}") / F.col("n") * SHARES), F.lit(SHARES)).cast("long"), 8 * (j % 8)) for j in range(k)]
    longs = [reduce(lambda x, y: x.bitwiseOR(y), packed[j : j + 8]).alias(f"parts{j // 8}") for j in range(0, k, 8)]
    table = store(sums.filter("word is not null").select("word", F.col("n").alias("c"), *longs), "hmm-emissions")
    discard(sums)
    shares = [F.shiftrightunsigned(F.col(f"parts{j // 8}"), 8 * (j % 8)).bitwiseAND(F.lit(255)) for j in range(k)]
    added = table.agg(*(F.sum(F.col("c") * x).alias(f"g{j}") for j, x in enumerate(shares))).collect()[0]
    whole = counts.sum(axis=0) + np.array([x or 0 for x in added]) / SHARES
    weight = whole / max(1.0, whole.sum())
    smooth = Smoothing(float(known.sum() + symbols), weight, whole + PRIOR + symbols * weight)
    each = known.copy()
    each[TAIL] = 0
    return Model(start, move, smooth.emissions(counts, each)), smooth, table


def _group(encoded: DataFrame, weights: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every text goes to the group with the largest start plus sum of its words' weights:
    occurrences by id, and texts, for each group."""
    shared = encoded.sparkSession.sparkContext.broadcast((weights, start))
    symbols, k = weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, start = shared.value
        counts, texts = np.zeros(symbols * k), np.zeros((1, k))
        for batch in batches:
            lists = _lists(batch.column(0), symbols)
            lengths = np.diff(lists.offsets.to_numpy())
            if not len(lengths):
                continue
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            begins = np.r_[0, np.cumsum(lengths)][:-1]  # no text is without its end token
            group = np.argmax(start + np.stack([np.add.reduceat(weights[:, j][flat], begins) for j in range(k)], axis=1), axis=1)
            texts += np.bincount(group, minlength=k)
            counts += np.bincount(np.repeat(group, lengths) * symbols + flat, minlength=len(counts))
        rows = np.concatenate([counts.reshape(k, symbols).T, texts])
        some = np.flatnonzero(rows.sum(axis=1))
        yield _rows(pa.nulls(len(some), pa.binary()), some, np.zeros(len(some)), rows[some])

    fields = [f"g{j}" for j in range(k)]
    parts = encoded.select("ids").mapInArrow(run, "row int, word binary, n long, " + ", ".join(f"{f} double" for f in fields))
    added = parts.groupBy("row").agg(*(F.sum(f).alias(f) for f in fields)).toArrow()  # head x states numbers
    rows = np.zeros((symbols + 1, k))
    for j in range(k):
        rows[added["row"].to_numpy(), j] = added[f"g{j}"].to_numpy()
    shared.destroy()
    return rows[:-1], rows[-1]


def _begin(encoded: DataFrame, prior: np.ndarray, states: int, refinements: int = 1) -> Model:
    """States from groups of all texts."""
    weights = np.random.default_rng(0).standard_normal((len(prior), states)) * -np.log(prior)[:, None]
    weights -= prior @ weights  # what is usual tells no groups apart
    start = np.zeros(states)
    for _ in range(1 + refinements):
        counts, texts = _group(encoded, weights, start)
        size = counts.sum(axis=0)
        centres = 0.5 * prior[:, None] + 0.5 * np.where(size > 0, counts / np.maximum(size, 1.0), prior[:, None])
        weights = np.log(centres / prior[:, None])
        start = np.log((texts + 1) / (texts + 1).sum())
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, centres)


def score(docs: DataFrame, held_out: Column, states: int = STATES, head_size: int = HEAD, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score and score (log10), learning from those that are not held out in
    ``rounds`` rounds, one at least."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    with small_batches(spark, BATCH):
        counts = count_words(rows.filter("not held_out"))
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.length("word") == 0, F.col("c"))).alias("ends")).collect()[0]
    n, v, ends = totals["n"] or 0, totals["v"], totals["ends"] or 0
    # the head: words with at least so many occurrences that it stays within its size
    least, size = 1, 0
    named = counts.filter(F.length("word") > 0)
    for r in named.groupBy("c").agg(F.count("*").alias("words")).orderBy(F.desc("c")).toLocalIterator():
        size += r["words"]
        if size > head_size:
            least = r["c"] + 1
            break
    top = named.filter(F.col("c") >= least).orderBy("word").toArrow()
    in_head = np.asarray(top["c"], dtype=np.float64)
    known = np.r_[ends, n - ends - in_head.sum(), in_head]  # by id
    prior = (known + 1) / (known + 1).sum()
    head = {w: FIRST + i for i, w in enumerate(top["word"].to_pylist())}
    with small_batches(spark, BATCH):
        encoded = encode(rows.withColumn("key", F.monotonically_increasing_id()), head, "text")
        discard(counts)
        release(spark)
        training = encoded.filter("not held_out")
        del head, top
        model = _begin(training, prior, states)
        for _ in range(rounds - 1):
            model = baum_welch(training, model, prior)
        model, smooth, table = last_round(training, model, known, v + (1 if ends else 2))
    release(spark)

    # words outside the head that training texts hold: where they are, by document
    told = encoded.select("key", F.posexplode("tail").alias("at", "word")).join(table, "word")
    by_doc = told.groupBy("key").agg(F.collect_list(F.struct("at", *table.columns[1:])).alias("rare"))
    shared = spark.sparkContext.broadcast((model, smooth, np.log10(np.where(np.arange(len(known)) == TAIL, 0, known) + 1), known > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, smooth, logs, seen = shared.value
        symbols, k = model.emit.shape
        for batch in _regrouped(batches, 3, symbols):
            lists, rare = _lists(batch.column(3), symbols), batch.column(4)
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).copy()
            begins = np.r_[0, np.cumsum(sizes)]
            # the place of a document's i-th word outside the head
            tails = np.flatnonzero(flat == TAIL)
            first = np.searchsorted(tails, begins[:-1])
            own = pc.fill_null(pc.list_value_length(rare), 0).to_numpy(zero_copy_only=False)
            found = rare.flatten()
            flat[tails[np.repeat(first, own) + found.field("at").to_numpy()]] = symbols + np.arange(len(found))
            c = found.field("c").to_numpy().astype(np.float64)
            parts = np.stack([found.field(f"parts{j}").to_numpy() for j in range(-(-k // 8))], axis=1).astype("<i8").view(np.uint8).reshape(len(found), 8 * -(-k // 8))[:, :k]
            g = parts * (c[:, None] / SHARES)
            here = Model(model.start, model.move, np.concatenate([model.emit, smooth.emissions(g, c)]))
            token_logs = np.r_[logs, np.log10(c + 1)][flat]
            base = np.add.reduceat(token_logs, begins[:-1]) if len(sizes) else np.zeros(0)
            token_seen = (np.r_[seen, c > 0] & (np.arange(symbols + len(c)) != TAIL))[flat]
            some = np.add.reduceat(token_seen.astype(np.int64), begins[:-1]) if len(sizes) else np.zeros(0, dtype=np.int64)
            likely = np.zeros(len(sizes))
            for at, size, ids in _blocks(lists, flat):
                likely[at] = _likely(here, size, ids)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *map(pa.array, (sizes, some, base, likely))], names=["doc_id", "held_out", "n_tokens", "n_known", "logs", "score"])

    schema = f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, logs double, score double"
    with small_batches(spark, BATCH):
        scored = store(encoded.select("key", "doc_id", "held_out", "ids").join(by_doc, "key", "left").select("key", "doc_id", "held_out", "ids", "rare").mapInArrow(run, schema), "hmm-scores")
    discard(encoded, table)
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        "score",
    )
