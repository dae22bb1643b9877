"""Near duplicates by SimHash, joined with keys from the Golay code.

A text's fingerprint has a bit for each of 64 places: whether more than half of
its shingles' hashes have it. Fingerprints link at four differing bits or fewer.

A fingerprint is cut into segments of 23, 23 and 18 bits. In the Golay code of
length 23 every word has one nearest codeword, three bits away at most; a
segment's keys are the codewords that it and its neighbours at one bit decode
to: one if it lies within two bits of its codeword, else six. Two segments that
differ in two bits have a common neighbour, hence a common key. Of four errors
no more than one segment can hold three, so two linked fingerprints share the
keys of two segments: a fingerprint goes by each pair of keys, 108 at most, and
fingerprints under one pair of keys are compared.

Fingerprints are told apart once, so copies cost nothing. Those of a pair of keys
with more than ``most`` of them are not compared; they meet by midpoints instead.
Of the values within two bits of a fingerprint, each goes to those that have this
pair of keys themselves, some 44; all that come to one value lie within four bits
of each other, so a chain through them keeps their component. Two linked
fingerprints have a value half way, at most one bit off in either segment, and
share its pair of keys, so this is exact as well; and what either way costs grows
with the number of fingerprints, however large a group of near copies is. Up to
``local`` fingerprints meet within the task that has their key; only beyond, the
values themselves are shuffled, so that no key must fit into a task.

Cases: null and empty texts, and texts of white space, have the fingerprint
zero and link like any other; texts with fewer words than a shingle have one,
of all their words; a text is taken whole, however long; rows with a null id get
their component's least id, null if it has no other; repeated rows are kept; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.components import components
from siltstone.llm.text import utf8, words
from siltstone.shared import store

SHINGLE, SEED, BITS = 4, 42, 64
LIMIT = 4  # differing bits
MOST = 64  # fingerprints under a key that are compared with each other
LOCAL = 1 << 16  # fingerprints under a key that meet within its task
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # first bit, width
PAIRS = ((0, 1), (0, 2), (1, 2))
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
HASHES = 1 << 16  # that are turned into bits at once
ROWS = 4_096  # fingerprints whose keys are made at once


def _shingles(found: list[bytes], size: int) -> list[bytes]:
    if len(found) <= size:
        return [b" ".join(found)] if found else []
    return list(map(b" ".join, zip(*(found[k:] for k in range(size)), strict=False)))


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """The 64 bits of a text, unsigned."""
    each = _shingles(words(text), size)
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(each), HASHES):
        some = each[k : k + HASHES]
        hashes = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in some), dtype=">u8", count=len(some))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(each)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, size) for t in utf8(batch.column(1))), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _syndromes(v: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit polynomials by the generator."""
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= np.where(v >> bit & 1, GENERATOR << (bit - 11), 0)
    return v


def _errors() -> np.ndarray:
    """The error of each syndrome: the one pattern of three bits or fewer that has it."""
    single = 1 << np.arange(23)
    two = single[:, None] ^ single[None, :]
    patterns = np.unique((two[:, :, None] ^ single[None, None, :]).ravel())
    patterns = np.union1d(np.union1d(patterns, two.ravel()), single)
    table = np.zeros(2048, dtype=np.int64)
    table[_syndromes(patterns)] = patterns
    return table


def segment_keys(segment: np.ndarray, width: int) -> np.ndarray:
    """For each segment the codewords, by their upper 12 bits, of itself and its
    neighbours at one bit, sorted; repeated ones are -1."""
    errors = _errors()
    near = segment[:, None] ^ np.r_[0, 1 << np.arange(width)]
    keys = np.sort((near ^ errors[_syndromes(near)]) >> 11, axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
    return keys


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, key) for each pair of segments' keys."""
    bits = fps.view(np.uint64)
    each = [segment_keys((bits >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64), width) for at, width in SEGMENTS]
    index, keys = [], []
    for n, (a, b) in enumerate(PAIRS):
        both = (n << 24) + (each[a][:, :, None] << 12) + each[b][:, None, :]
        row, i, j = np.nonzero((each[a] >= 0)[:, :, None] & (each[b] >= 0)[:, None, :])
        index.append(row)
        keys.append(both[row, i, j])
    return np.concatenate(index), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp)."""
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for k in range(0, len(fps), ROWS):
            index, keys = keys_of(fps[k : k + ROWS])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[k : k + ROWS][index])], names=["key", "fp"])


def _halves(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All changes of two bits at most, of them one at most in segment a and in segment
    b: (number of the change in a, in b, bits), numbers as in ``segment_keys``."""
    (at_a, wide_a), (at_b, wide_b) = SEGMENTS[a], SEGMENTS[b]
    at_c, wide_c = SEGMENTS[3 - a - b]
    single = [1 << at_c + k for k in range(wide_c)]
    other = {0: [0], 1: single, 2: [x | y for n, x in enumerate(single) for y in single[:n]]}
    told = []
    for i in range(wide_a + 1):
        for j in range(wide_b + 1):
            bits = (1 << at_a + i - 1 if i else 0) | (1 << at_b + j - 1 if j else 0)
            told += [(i, j, bits | x) for n in range(3 - (i > 0) - (j > 0)) for x in other[n]]
    i, j, bits = zip(*told, strict=True)
    return np.array(i), np.array(j), np.array(bits, dtype=np.uint64)


class _Midpoints:
    """The values half way between fingerprints under a pair of keys."""

    def __init__(self) -> None:
        self.errors, self.halves = _errors(), [_halves(a, b) for a, b in PAIRS]

    def _has(self, bits: np.ndarray, segment: int, key: int) -> np.ndarray:
        """For each change of one bit whether the segment's word then is the key's."""
        at, width = SEGMENTS[segment]
        near = (bits >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)[:, None] ^ np.r_[0, 1 << np.arange(width)]
        return (near ^ self.errors[_syndromes(near)]) >> 11 == key

    def of(self, fps: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
        """(index, value): all values within two bits that have the key themselves."""
        a, b = PAIRS[key >> 24]
        i, j, change = self.halves[key >> 24]
        bits, rows, values = fps.view(np.uint64), [], []
        for k in range(0, len(bits), 512):
            some = bits[k : k + 512]
            row, col = np.nonzero(self._has(some, a, key >> 12 & 0xFFF)[:, i] & self._has(some, b, key & 0xFFF)[:, j])
            rows.append(row + k)
            values.append((some[row] ^ change[col]).view(np.int64))
        return np.concatenate(rows), np.concatenate(values)

    def stars(self, fps: np.ndarray, key: int) -> np.ndarray:
        """Links (a, b) from each fingerprint to the first of those that it leads to."""
        row, value = self.of(fps, key)
        order = np.lexsort((row, value))
        row, value = row[order], value[order]
        meet = value[1:] == value[:-1]
        a, b = row[:-1][meet], row[1:][meet]
        first = np.arange(len(fps))
        while True:
            new = first.copy()
            np.minimum.at(new, a, first[b])
            np.minimum.at(new, b, first[a])
            new = new[new]
            if (new == first).all():
                break
            first = new
        own = np.flatnonzero(first != np.arange(len(fps)))
        return np.stack([fps[first[own]], fps[own]])


def _compared(most: int, local: int):
    """Over rows (key, fp) in order: links (a, b, -1) between fingerprints of a key,
    and (a, a, key) for the fingerprints of keys with more than ``local``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, over, midpoints = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), -1, _Midpoints()

        def links(keys: np.ndarray, fps: np.ndarray) -> Iterator[np.ndarray]:
            heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            each = np.diff(np.r_[heads, len(keys)])
            sizes = np.repeat(each, each)
            many = (sizes > local) | (keys == over)
            yield np.stack([fps[many], fps[many], keys[many]])
            for g in np.flatnonzero((each > most) & (each <= local) & (keys[heads] != over)).tolist():
                own = midpoints.stars(fps[heads[g] : heads[g] + each[g]], int(keys[heads[g]]))
                yield np.r_[own, np.full((1, own.shape[1]), -1)]
            i = np.flatnonzero((sizes > 1) & (sizes <= most) & ~many)
            for d in range(1, most):
                i = i[i + d < len(keys)]
                i = i[keys[i] == keys[i + d]]
                if not len(i):
                    break
                near = i[np.bitwise_count((fps[i] ^ fps[i + d]).view(np.uint64)) <= LIMIT]
                yield np.stack([fps[near], fps[near + d], np.full(len(near), -1)])

        def told(upto: int) -> Iterator[pa.RecordBatch]:
            found = np.unique(np.concatenate(list(links(keys[:upto], fps[:upto])), axis=1), axis=1)
            if found.size:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b", "key"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy()])
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            if last:
                yield from told(last)
            keys, fps = keys[last:], fps[last:]
            if len(keys) > local or keys[0] == over:
                over = keys[0]
                yield from told(len(keys))
                keys, fps = keys[:0], fps[:0]
        if len(keys):
            yield from told(len(keys))

    return run


def _valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mid, fp) for the midpoints of rows (fp, key)."""
    midpoints = _Midpoints()
    for batch in batches:
        fps, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for key in np.unique(keys).tolist():
            own = fps[keys == key]
            row, value = midpoints.of(own, key)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(own[row])], names=["mid", "fp"])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (mid, fp) in order: neighbours with one midpoint."""
    mid, fp = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    for batch in batches:
        mid, fp = np.concatenate([mid[-1:], batch.column(0).to_numpy()]), np.concatenate([fp[-1:], batch.column(1).to_numpy()])
        i = np.flatnonzero((mid[1:] == mid[:-1]) & (fp[1:] != fp[:-1]))
        if len(i):
            both = np.unique(np.stack([fp[i], fp[i + 1]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])


def linked(fps: DataFrame, most: int = MOST, local: int = LOCAL) -> DataFrame:
    """(node, comp): the components, of more than one, of distinct fingerprints (fp)."""
    dealt = fps.select("fp").mapInArrow(_keyed, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    found = store(dealt.mapInArrow(_compared(most, local), "a long, b long, key long"), "simhash-links")
    # dealt out by number, as their bytes say too little of what becomes of them
    spread = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crowded = found.filter("key >= 0").select(F.col("a").alias("fp"), "key").distinct().repartition(spread, "fp")
    met = crowded.mapInArrow(_valued, "mid long, fp long").repartition("mid").sortWithinPartitions("mid", "fp")
    edges = found.filter("key < 0").select("a", "b").unionByName(met.mapInArrow(_chained, "a long, b long")).distinct()
    return components(store(edges, "simhash-edges"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, most: int = MOST) -> DataFrame:
    """For each row doc_id, fingerprint (16 hexadecimal digits) and component_id, the
    least id that links lead to."""
    each = store(fingerprints(docs, id_col, text_col, size), "simhash")
    own = store(each.groupBy("fp").agg(F.min("doc_id").alias("own")), "simhash-distinct")
    comps = linked(own, most=most)
    least = own.join(comps.withColumnRenamed("node", "fp"), "fp").groupBy("comp").agg(F.min("own").alias("least"))
    of = own.join(comps.withColumnRenamed("node", "fp").join(least, "comp"), "fp", "left").select("fp", F.coalesce("least", "own").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return each.join(of, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")
