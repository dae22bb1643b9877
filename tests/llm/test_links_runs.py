"""Hard negatives, SimHash near duplicates and periodic runs, against brute force."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import negatives, periodicity, queries, simhash, surrogates, toxicity

SF = "/root/testdata/sf0.001"


# --- periodic runs


def brute_runs(w):
    """All runs (start, length, period) by comparing the words at every distance."""
    w, found = np.array(w), {}
    for p in range(1, len(w) // 2 + 1):
        step = np.diff(np.r_[0, (w[:-p] == w[p:]).astype(int), 0])
        for s, e in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
            if e + p - s >= max(12, 2 * p):
                found.setdefault((s, e + p), p)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def made_text(rng):
    n, kind = rng.randrange(400), rng.randrange(8)
    if kind < 2:
        return [rng.randrange(1 + rng.randrange(4)) for _ in range(n)]
    if kind == 2:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 3:  # two regions of one small period out of step, and their squares
        root = [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
        x = root * rng.randrange(1, 80)
        y = x[::-1] if rng.random() < 0.5 else x[rng.randrange(len(root)) :]
        return x + [rng.randrange(3) for _ in range(rng.randrange(3))] + y + x
    if kind == 4:
        root = [rng.randrange(50) for _ in range(rng.randrange(1, 100))]
        return [rng.randrange(50) for _ in range(rng.randrange(30))] + (root * 9)[: rng.randrange(1, 9 * len(root))] + [rng.randrange(50)]
    if kind == 5:
        root = [rng.randrange(3) for _ in range(rng.randrange(1, 6))]
        block = root * rng.randrange(1, 40) + [rng.randrange(4) for _ in range(rng.randrange(6))]
        return (block * rng.randrange(1, 5))[: rng.randrange(1, 600)]
    if kind == 6:
        x = [rng.randrange(3) for _ in range(rng.randrange(1, 20))]
        while len(x) < 300:
            x = x + x[-rng.randrange(1, len(x) + 1) :] + [rng.randrange(3)] * rng.randrange(2)
        return x
    x = [0]
    while len(x) < n:
        x = x + [1 - v for v in x]
    return x[:n]


@pytest.mark.parametrize("seed", range(4))
def test_all_runs_of_repetitive_texts(seed):
    rng = random.Random(seed)
    texts = [made_text(rng) for _ in range(150)]
    got = periodicity.runs_in(np.array([v for t in texts for v in t], dtype=np.int64), np.array([len(t) for t in texts]))
    assert list(map(tuple, got.tolist())) == [(k, *r) for k, t in enumerate(texts) for r in brute_runs(t)]


def test_runs_of_one_very_long_text():
    rng = np.random.default_rng(3)
    root = rng.integers(0, 5_000, 60_001)
    words = np.r_[rng.integers(0, 5_000, 500), np.tile(root, 4)[: 60_001 * 3 + 17], [9_999], np.tile([1, 2, 3], 5_000)]
    got = periodicity.runs_in(words, np.array([len(words)]))[:, 1:].tolist()
    assert got == [[500, 180_020, 60_001], [len(words) - 15_000, 15_000, 3]]


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_op13(spark):
    got = {r["doc_id"]: r for r in queries.op13_periodicity(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    planted = 0
    for doc_id, text in rows:
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        words = [w.decode() for w in words]
        numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
        runs = brute_runs([numbers[w] for w in words]) if words else []
        runs.sort(key=lambda r: (r[0], r[2]))
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        r = got[doc_id]
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert planted and any(r["n_runs"] for r in got.values())


def test_runs_cases(spark):
    odd = "a\x1cb c\x85d e\u00a0f"  # three words: only the blanks part them
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "x " * 30), (4, "x " * 30), (None, "\v a\fb\rc\n" * 5), (6, odd + " " + odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit(1), "collapsed": F.lit(2), "n_words": F.lit(3)})
    got = sorted((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodicity.periodic_runs(docs).collect())
    assert got == [
        (0, 15, [(0, 15, 3)], "a b c"),
        (1, 0, [], ""),
        (2, 0, [], ""),
        (3, 0, [], ""),
        (4, 30, [(0, 30, 1)], "x"),
        (4, 30, [(0, 30, 1)], "x"),
        (6, 6, [], odd + " " + odd),
    ]
    assert periodicity.periodic_runs(docs.limit(0)).collect() == []


def test_planted_runs_leave_null_and_empty_texts(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    docs = spark.createDataFrame([(ids[0], None), (ids[1], ""), (ids[2], "one"), (None, "two words")], "doc_id long, text string")
    assert {(r[0], r[1]) for r in queries.planted_runs(docs).collect()} == {(ids[0], None), (ids[1], ""), (ids[2], "one"), (None, "two words")}


# --- SimHash


def brute_fingerprint(text):
    w = (text or "").lower() if (text or "").isascii() else "".join(c.lower() if c.isascii() else c for c in text or "")
    w = w.encode().split()
    each = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in each]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """{id: least id} over (id, fingerprint)."""
    comp = {i: i for i, _ in fps}

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, x in fps:
        for b, y in fps:
            if a < b and (x ^ y).bit_count() <= 4:
                ra, rb = top(a), top(b)
                comp[max(ra, rb)] = min(ra, rb)
    return {i: top(i) for i in comp}


def test_op12(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fps = [(r[0], brute_fingerprint(r[1])) for r in rows]
    want = brute_components(fps)
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op12_simhash(spark, SF).collect()}
    assert got == {(i, f"{f:016x}", want[i]) for i, f in fps}
    assert len(set(want.values())) < len(want)


def test_fingerprints_equal_sparks_hash(spark):
    """XXH64 with seed 42 is what Spark's own function computes."""
    got = simhash.fingerprints(spark.createDataFrame([(1, "Ünë DEUX trois")], "doc_id long, text string")).collect()[0]["fp"]
    assert got == spark.range(1).select(F.xxhash64(F.lit("Ünë deux trois"))).collect()[0][0]


def signed(x):
    return x - 2**64 if x >= 2**63 else x


@pytest.mark.parametrize("most, local", [(2, 20), (2, 10**6), (64, 10**6)])
def test_links_of_crowded_and_lone_fingerprints(spark, most, local):
    """Chains at exactly four bits, a ball of near ones with frequent keys, and pairs at five."""
    rng = random.Random(5)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    fps = {0, 2**64 - 1}
    for d in range(6):
        for _ in range(30):
            x = rng.getrandbits(64)
            fps |= {x, flip(x, d)}
    centre = rng.getrandbits(64)
    fps |= {flip(centre, rng.randrange(1, 7)) for _ in range(250)}
    x = centre
    for _ in range(40):
        x = flip(x, 4)
        fps.add(x)
    numbered = sorted(fps)
    want = brute_components(list(enumerate(numbered)))
    df = spark.createDataFrame([(signed(x),) for x in numbered], "fp long").repartition(3)
    comp = {r["node"] % 2**64: r["comp"] for r in simhash.linked(df, most, local).collect()}
    groups = {}
    for i, x in enumerate(numbered):
        groups.setdefault(want[i], set()).add(comp.get(x, ("alone", x)))
    assert all(len(g) == 1 for g in groups.values())
    assert len(set().union(*groups.values())) == len(groups)


def test_simhash_cases(spark):
    rows = [(5, None), (3, ""), (9, " \t"), (7, "one two"), (7, "ONE  two"), (8, "Ä b c d e"), (2, "ä b c d e"), (None, "one two"), (None, "lone text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "component_id": F.lit(0), "fingerprint": F.lit("x")})
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert {g for g in got if g[0] in (3, 5, 9)} == {(i, "0" * 16, 3) for i in (3, 5, 9)}
    assert [g[2] for g in got if g[0] == 7] == [7, 7] and len({g[1] for g in got if g[2] == 7}) == 1
    assert sorted(str(g[2]) for g in got if g[0] is None) == ["7", "None"]
    assert len(got) == len(rows)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_a_very_long_text_has_one_fingerprint(spark):
    text = " ".join(str(random.Random(1).randrange(10**6) + k) for k in range(150_000))
    got = simhash.fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]["fp"]
    assert got % 2**64 == simhash.fingerprint(text.encode()) == brute_fingerprint(text)


# --- hard negatives


def brute_negatives(rows, is_anchor, k=5, scale=256):
    """rows: (id, label, vector)."""
    whole = [(i, label, [int(np.floor(scale * float(x))) for x in v]) for i, label, v in rows]
    out = []
    for n, (i, label, v) in enumerate(whole):
        if not is_anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), j, other == label) for m, (j, other, w) in enumerate(whole) if m != n and len(w) == len(v)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p, pid, _ in [s for s in scored if s[2]][:k]:
            hard = [s for s in scored if not s[2] and 80 * p <= 100 * s[0] <= 100 * p][:k]
            out += [(i, pid, r + 1, s[1], p, s[0]) for r, s in enumerate(hard)]
    return sorted(out)


def mined(df, **more):
    found = negatives.mine(df, F.col("vec_id") % 5 == 0, F.col("label"), **more)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")


@pytest.mark.parametrize("anchor_bytes", [negatives.ANCHOR_BYTES, 4_000])
def test_negatives_of_clustered_vectors(spark, monkeypatch, anchor_bytes):
    """Ties, repeated ids and several broadcasts."""
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", anchor_bytes)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(4, 6))
    rows = [(n % 190, int(rng.integers(3)), (centres[n % 4] + 0.2 * rng.normal(size=6)).astype(np.float32).tolist()) for n in range(230)]
    rows += [(300 + n, n % 3, [0.5, 0.25, 0.0, 0.0, 0.0, 1.0]) for n in range(20)]  # one vector, all labels
    rows += [(400, 1, [1.0, 2.0]), (405, 1, [2.0, 1.0]), (406, 0, [2.0, 0.5]), (410, 2, [0.0, 0.0])]
    assert mined(vectors(spark, rows).repartition(3)) == brute_negatives(rows, lambda i: i % 5 == 0)


def test_negatives_cases(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, 1, [1.0, 0.0]), (1, 1, [0.5, 0.5]), (2, 0, [0.5, 0.4]), (3, 0, [0.45, 0.0]), (5, 1, [-1.0, 0.0]), (10, 7, [1.0, 1.0])]
    bad = [(None, 1, [1.0, 0.0]), (15, None, [1.0, 0.0]), (20, 1, None), (25, 1, [1.0, None]), (30, 1, [nan, 0.0]), (35, 1, [inf, 0.0]), (40, 1, [])]
    df = vectors(spark, good + bad).withColumns({"row": F.lit(1), "id": F.lit(1), "v": F.lit(1), "is_anchor": F.lit(1), "anchor_id": F.lit(1)})
    want = brute_negatives(good, lambda i: i % 5 == 0)
    assert mined(df) == want and want
    assert mined(df.limit(0)) == []
    assert mined(vectors(spark, [r for r in good if r[0] % 5])) == []  # no anchor
    assert mined(vectors(spark, [(0, 1, [1.0]), (5, 1, [1.0])])) == []  # no negative


def test_negatives_of_large_numbers(spark):
    rows = [(0, 1, [1e7, 1.0]), (1, 1, [1e7, 2.0]), (2, 0, [1e7 - 16, 3.0]), (3, 0, [9e6, 4.0]), (4, 0, [1.0, 1.0])]
    want = brute_negatives(rows, lambda i: i % 5 == 0)
    assert mined(vectors(spark, rows)) == want and want[0][-1] > 2**53


def test_the_walk_ends_before_the_end():
    """On clustered vectors most scores are never computed."""
    rng = np.random.default_rng(4)
    centres = np.round(100 * rng.normal(size=(40, 16)))
    v = centres[rng.integers(40, size=8_000)] + np.round(5 * rng.normal(size=(8_000, 16)))
    block = {"v": v, "norms": np.linalg.norm(v, axis=1), "ids": np.arange(8_000), "rows": np.arange(8_000), "labels": np.zeros(8_000, np.int64)}
    own = v[:400]
    group = {"v": own, "norms": np.linalg.norm(own, axis=1), "largest": np.abs(own).max(), "clusters": negatives.clusters(own), "rows": np.arange(400), "labels": np.zeros(400, np.int64)}
    lists = negatives._Lists(400, 5)
    assert negatives._walk(block, group, lists, None, None) < 0.5 * 400 * 8_000
    scores = own @ v.T
    scores[np.arange(400), np.arange(400)] = -1e9
    assert (lists.scores == -np.sort(-scores, axis=1)[:, :5]).all()


# --- texts that took the square of their length


def test_exceptions_of_a_very_long_text():
    """Merged exceptions spare what testing each of them spares, in linear time."""
    lexicon = toxicity.Lexicon({b" trash": 2.0, b" scum ": 1.5, b" fish": 1.0})
    rng = random.Random(2)
    phrases = ["trash can ", "pond scum ", "class clown fish ", "scum ", "clown ", "trashy ", "fish ", "take out the trash bin "]
    said = "".join(rng.choice(phrases) for _ in range(300)).encode()
    look, spared = b" " + toxicity.fold(said) + b" ", [b" " + toxicity.fold(e.encode()) + b" " for e in toxicity.EXCEPTIONS]
    spans = [(i, i + len(p) - 1) for p in spared for i in range(len(look)) if look[i : i + len(p)] == p]
    want = {i for e in lexicon.weights for i in range(len(look)) if look[i : i + len(e)] == e and not any(a <= i < z for a, z in spans)}
    assert [i for i, _ in lexicon.matches(said)] == sorted(want) != []
    began = time.time()
    assert lexicon.matches(b"trash can " * 200_000) == []
    assert time.time() - began < 10


def test_many_names_in_one_text():
    """Mentions are looked up in the text's words once, not once for each name."""
    rng = random.Random(3)
    names = {"".join(rng.choice("abcdefghijklmnop") for _ in range(9)).capitalize() for _ in range(20_000)}
    text = "".join(f"Mr. {n} came. " for n in names)
    began = time.time()
    found = surrogates.find(text)
    assert time.time() - began < 60 and len(found) >= len(names)
