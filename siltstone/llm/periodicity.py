"""Periodic runs of words, found with string synchronising sets.

A run is a stretch of consecutive words with smallest period q that is at least
``max(12, 2 q)`` words long and that neither neighbour extends. All of them are
found, and the text without their repetitions is returned as well.

Periods are looked for at dyadic scales. At scale t a window of t words has an
identity, a hash of its words; a position belongs to the synchronising set if
the least identity of the t + 1 windows from it on is the first or the last of
them. Whether it does depends on the 2 t words from there on alone, so copies
of a passage select the same positions. A period from 4 t to 8 t shows as two
selected positions with equal contexts at just that distance. Highly periodic
windows (period of t / 3 at most) have no identity, which leaves few positions
with equal contexts near each other, but none in long periodic regions. Those
are known from smaller scales, and where one ends and another of the same
period begins, they supply the periods that are left: those by which the first
falls in step with the second. Periods below 8 are compared directly.

Every proposal is extended word by word before it counts, so hashes decide only
where to look. The words of a batch stand in one array, the longest text first,
each closed by a number that occurs once; so each scale takes one pass over the
texts that are long enough. Work for n words is about n log n.

Cases: null and empty texts, and texts of white space, have no words, no runs
and collapse to an empty text; a text is taken whole, however long; repeated
rows and null ids are rows like any other; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.text import mix

LEAST = 12  # words of a run
DIRECT = 8  # periods below it are compared directly; twice the context of the first scale
WIDEST = 4_096  # words that are compared at once
CELLS = 1 << 20  # pairs of words that are compared at once
BATCH_BYTES = 4 << 20  # of the texts that are searched together; one text may have more
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.iinfo(np.uint64).max


def _reach(w: np.ndarray, i: np.ndarray, j: np.ndarray, sign: int) -> np.ndarray:
    """How many words agree from i and j onwards (sign 1) or backwards (-1)."""
    out = np.zeros(len(i), dtype=np.int64)
    left, width = np.arange(len(i)), 4
    while len(left):
        offsets, more = sign * np.arange(width), []
        for k in range(0, len(left), max(1, CELLS // width)):
            some = left[k : k + max(1, CELLS // width)]
            at = sign * out[some]
            same = w[(i[some] + at)[:, None] + offsets] == w[(j[some] + at)[:, None] + offsets]
            whole = same.all(axis=1)
            out[some] += np.where(whole, width, same.argmin(axis=1))
            more.append(some[whole])
        left, width = np.concatenate(more), min(2 * width, WIDEST)
    return out


def _runs_of(w: np.ndarray, i: np.ndarray, last: np.ndarray, p: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of what words equal at distance p from i to last extend to, if long enough."""
    start = i - _reach(w, i - 1, i + p - 1, -1)
    end = last + p + _reach(w, last, last + p, 1)
    found = np.stack([start, end, p], axis=1)
    return found[end - start >= least]


def _direct(w: np.ndarray, cut: int) -> list[np.ndarray]:
    """Runs of small periods. Shorter ones of periods 1 and 2 tell which windows are highly periodic."""
    found = []
    for p in range(1, DIRECT):
        least = {1: 4, 2: 8}.get(p, max(LEAST, 2 * p))
        at = np.arange(WIDEST, WIDEST + cut, least - p)  # every stretch of equal words holds one of these
        at = at[w[at] == w[at + p]]
        found.append(np.unique(_runs_of(w, at, at + 1, np.full(len(at), p), least), axis=0))
    return found


def _covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the stretches."""
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def _synchronising(ident: np.ndarray, t: int) -> np.ndarray:
    """Positions whose window, or the one t further, is the least of the t + 1."""
    least, width = ident, 1
    while width < t:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[:-1], ident[t:])
    first = ident[: len(least)]
    return np.flatnonzero((least != _NONE) & ((least == first) | (least == ident[t:])))


def _by_contexts(w: np.ndarray, ident: np.ndarray, context: np.ndarray, t: int) -> np.ndarray:
    """Runs with periods from 4 t to 8 t that two synchronising positions with equal contexts propose."""
    at = _synchronising(ident, t)
    at = at[at < len(context)]
    order = np.argsort(context[at], kind="stable")
    at, said = at[order], context[at][order]
    pairs, i = [], np.arange(len(at))
    for nth in range(1, len(at)):
        i = i[i + nth < len(at)]
        i = i[(said[i] == said[i + nth]) & (at[i + nth] - at[i] < 8 * t)]
        if not len(i):
            break
        far = i[at[i + nth] - at[i] >= 4 * t]
        pairs.append(np.stack([at[far + nth] - at[far], at[far]], axis=1))
    if not pairs:
        return np.empty((0, 3), dtype=np.int64)
    pairs = np.unique(np.concatenate(pairs), axis=0)
    p, i = pairs[:, 0], pairs[:, 1] + WIDEST
    # contexts of 2 t words that touch are one stretch; hashes that only look equal are dropped first
    same = _reach_up_to(w, i, i + p, 2 * t)
    p, i = p[same], i[same]
    if not len(i):
        return np.empty((0, 3), dtype=np.int64)
    heads = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (i[1:] - i[:-1] > 2 * t)])
    tails = np.r_[heads[1:], len(i)] - 1
    return _runs_of(w, i[heads], i[tails] + 2 * t, p[heads], np.maximum(LEAST, 2 * p[heads]))


def _reach_up_to(w: np.ndarray, i: np.ndarray, j: np.ndarray, width: int) -> np.ndarray:
    """Whether width words agree."""
    good = np.ones(len(i), dtype=bool)
    for k in range(0, width, WIDEST):
        offsets = np.arange(k, min(width, k + WIDEST))
        left, rows = np.flatnonzero(good), max(1, CELLS // len(offsets))
        for x in range(0, len(left), rows):
            some = left[x : x + rows]
            good[some] = (w[i[some][:, None] + offsets] == w[j[some][:, None] + offsets]).all(axis=1)
    return good


def _by_regions(w: np.ndarray, known: np.ndarray, t: int) -> list[np.ndarray]:
    """Runs with periods from 4 t to 8 t whose first period lies in a region of period q of t / 3 at most."""
    regions = known[(3 * known[:, 2] <= t) & (known[:, 1] - known[:, 0] >= 4 * t)]
    regions = regions[np.lexsort((regions[:, 0], regions[:, 2]))]
    meets = np.flatnonzero((regions[1:, 2] == regions[:-1, 2]) & (regions[1:, 0] <= regions[:-1, 1]))
    found = []
    for (a, b, q), (a2, b2, _) in zip(regions[meets].tolist(), regions[meets + 1].tolist(), strict=True):
        root = w[a2 : a2 + q]
        x = next((a + k for k in range(q) if np.array_equal(w[a + k : a + k + q], root)), None)
        if x is None:
            continue
        # in step from a2 - p on, for each p that leaves the remainder of a2 - x; one more begins before a
        most = a2 - x + q
        p = np.arange(most - max(0, -(-(most - 8 * t + 1) // q)) * q, 4 * t - 1, -q)
        p = p[p <= b2 - a2]
        start = np.maximum(a, a2 - p)
        equal = np.minimum(b - start, b2 - start - p)
        ok = equal > 0
        p, start, equal = p[ok], start[ok], equal[ok]
        tied = (b - start == b2 - start - p) | (start == a)  # both break at once, or both begin: words decide
        end = start + p + equal
        plain = np.stack([start, end, p], axis=1)[~tied]
        found.append(plain[plain[:, 1] - plain[:, 0] >= 2 * plain[:, 2]])
        found.append(_runs_of(w, start[tied], start[tied] + equal[tied], p[tied], 2 * p[tied]))
    return found


def runs_in(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period), by text, start and period, of all runs of
    texts of the given sizes, whose words' numbers, from 0 up, stand in one array."""
    order = np.argsort(-sizes, kind="stable")
    ends = np.cumsum(sizes[order] + 1)  # a closing number each
    n = int(ends[-1]) if len(ends) else 0
    w = -1 - np.arange(n + 2 * WIDEST + 8, dtype=np.int64)
    starts = WIDEST + ends - sizes[order] - 1
    moved = np.empty(len(sizes), dtype=np.int64)
    moved[order] = starts
    w[np.arange(len(codes)) + np.repeat(moved - np.r_[0, np.cumsum(sizes)[:-1]], sizes)] = codes
    known = np.concatenate(_direct(w, n)) if n else np.empty((0, 3), dtype=np.int64)
    t, hashed = 1, mix(w[WIDEST:].astype(np.uint64) * _STEP + np.uint64(1))
    while True:
        longer = int(np.searchsorted(-sizes[order], -8 * t * 2, side="right"))  # texts with room for the scale 2 t
        if not longer:
            break
        cut = int(ends[longer - 1])
        if t == 1:
            hashed, t = mix(hashed[:-1] * _STEP + hashed[1:]), 2
        else:
            hashed, t = context, 2 * t
        hashed = hashed[: cut + 2 * t]
        context = mix(hashed[:-t] * _STEP + hashed[t:])
        small = known[(3 * known[:, 2] <= t) & (known[:, 1] - known[:, 0] >= t) & (known[:, 0] < WIDEST + cut)]
        ident = hashed.copy()
        ident[_covered(len(ident), small[:, 0] - WIDEST, small[:, 1] - WIDEST - t + 1)] = _NONE
        new = [_by_contexts(w, ident, context, t), *_by_regions(w, known, t)]
        known = np.concatenate([known, *new])
    known = known[known[:, 1] - known[:, 0] >= np.maximum(LEAST, 2 * known[:, 2])]
    known = known[np.lexsort((known[:, 2], known[:, 1], known[:, 0]))]
    if len(known):  # of one stretch the smallest period
        known = known[np.r_[True, (known[1:, :2] != known[:-1, :2]).any(axis=1)]]
    place = np.searchsorted(starts, known[:, 0], side="right") - 1
    out = np.stack([order[place], known[:, 0] - starts[place], known[:, 1] - known[:, 0], known[:, 2]], axis=1) if len(known) else np.empty((0, 4), dtype=np.int64)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _told(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """(doc_id, n_words, runs, collapsed) of some texts."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    found = lists.flatten()
    real = pc.greater(pc.binary_length(found), 0)  # white space at either end leaves empty pieces
    ends = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))][lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    found = found.filter(real)
    codes = found.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    runs = runs_in(codes, np.diff(ends))
    first = ends[runs[:, 0]]
    kept = ~_covered(len(codes), first + runs[:, 1] + runs[:, 3], first + runs[:, 1] + runs[:, 2])
    left = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept)][ends].astype(np.int32)), found.filter(pa.array(kept)))
    fields = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], names=["start", "length", "period"])
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(runs[:, 0], np.arange(len(ends))).astype(np.int32)), fields)
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(ends)), spans, pc.binary_join(left, " ")], names=["doc_id", "n_words", "runs", "collapsed"])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text), some megabytes at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        turn = np.cumsum(sizes) // BATCH_BYTES
        heads = np.r_[np.flatnonzero(np.r_[True, turn[1:] != turn[:-1]]), len(turn)] if len(turn) else [0]
        for a, b in zip(heads[:-1], heads[1:], strict=True):
            yield _told(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, n_words, runs (start, length, period, by start and
    period) and collapsed, the text of one round of each run, joined by spaces."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_searched, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string")


def longest(runs: Column) -> Column:
    """Of an array of runs the longest, of those the first, then that of the smallest
    period; null if there is none."""
    key = lambda r: F.struct(-r["length"], r["start"], r["period"])
    return F.get(F.array_sort(runs, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)), F.lit(0))
