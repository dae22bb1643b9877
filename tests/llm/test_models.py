"""Language model, quality, toxicity: exactness and held-out accuracy."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import hmm, quality, toxicity
from siltstone.llm.text import words


def texts(n=120, seed=5):
    rng = random.Random(seed)
    kinds = [[f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]]
    rows = []
    for i in range(n):
        k = kinds[i % 2]
        rows.append((i, " ".join(rng.choice(k) for _ in range(rng.randint(0, 60)))))
    return [*rows, (n, None), (n + 1, "Unseen words ONLY here"), (3, rows[3][1])]


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def test_hmm_counts_base_and_gain(spark):
    rows = texts()
    got = hmm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2, states=3, head_size=50, rounds=4).collect()
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update([*words((t or "").encode()), b""])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t in rows:
        tokens = [*words((t or "").encode()), b""]
        r = by[i]
        assert r["held_out"] == held(i) and r["n_tokens"] == len(tokens) and r["train_tokens"] == n
        assert r["n_known"] == sum(counts[w] > 0 for w in tokens)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), abs_tol=1e-9)
    out = [r for r in got if r["held_out"] and r["n_tokens"] > 5 and r["doc_id"] < 120]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_hmm_forward_is_exact_likelihood_and_training_raises_it():
    rng = np.random.default_rng(0)
    k, symbols = 3, 6
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), size=k), rng.dirichlet(np.ones(symbols), size=k).T)
    seqs = [[1, 2, 0], [4, 4, 5, 1, 0], [0]]

    def brute(m, seq):
        import itertools

        return sum(np.prod([m.start[p[0]]] + [m.move[a, b] for a, b in zip(p, p[1:], strict=False)] + [m.emit[s, z] for s, z in zip(seq, p, strict=True)]) for p in itertools.product(range(k), repeat=len(seq)))

    import pyarrow as pa

    found = np.zeros(3)
    total = np.zeros(k), np.zeros((k, k)), np.zeros((symbols, k))
    for rows, size, ids in hmm._blocks(pa.array(seqs, type=pa.list_(pa.int32()))):
        _, _, scale, _ = hmm._forward(model, size, ids)
        found[rows] = scale.prod(axis=0)
        hmm._expected(model, size, ids, total)
    assert np.allclose(found, [brute(model, s) for s in seqs])
    assert math.isclose(total[0].sum(), 3) and math.isclose(total[1].sum(), 2 + 4) and math.isclose(total[2].sum(), 9)
    after = hmm.Model(total[0] / total[0].sum(), total[1] / total[1].sum(axis=1, keepdims=True), total[2] / total[2].sum(axis=0))
    assert sum(math.log(brute(after, s)) for s in seqs) > sum(math.log(brute(model, s)) for s in seqs)


def test_hmm_long_texts_in_spans_are_the_same(monkeypatch):
    rng = np.random.default_rng(1)
    k, symbols = 3, 7
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), size=k), rng.dirichlet(np.ones(symbols), size=k).T)
    size = np.array([23, 20, 8, 1])
    ids = np.where(np.arange(23)[:, None] < size, rng.integers(0, symbols, (23, 4)), 0)
    found = []
    for span in (1 << 15, 5):
        monkeypatch.setattr(hmm, "SPAN", span)
        total = np.zeros(k), np.zeros((k, k)), np.zeros((symbols, k))
        hmm._expected(model, size, ids, total)
        found.append((*total, hmm._likely(model, size, ids)))
    assert all(np.allclose(a, b, rtol=1e-12) for a, b in zip(*found, strict=True))
    assert math.isclose(found[1][1].sum(), sum(size - 1)) and math.isclose(found[1][2].sum(), sum(size))


def test_hmm_words_outside_the_head_have_emissions_of_their_own(spark):
    """One state is a smoothed unigram, whatever the head's size; with more states rare words of one kind raise each other."""
    rows = [(i, t) for i, t in enumerate(["a b c", "a b d d", "a e", None, "f g h i j"])] + [(10, "a d zz"), (11, "h q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = Counter(w for i, t in rows if i < 10 for w in [*words((t or "").encode()), b""])
    n, s = sum(counts.values()), len(counts) + 1
    for head_size in (0, 2, 100):
        got = {r["doc_id"]: r for r in hmm.score(df, F.col("doc_id") >= 10, states=1, head_size=head_size, rounds=2).collect()}
        for i, t in rows:
            tokens = [*words((t or "").encode()), b""]
            want = sum(math.log10((counts[w] + hmm.PRIOR * (counts[w] + 1) / (n + s) + 1) / (n + hmm.PRIOR + s)) for w in tokens)
            assert math.isclose(got[i]["score"], want, abs_tol=1e-6)
    kinds = [[f"a{i}" for i in range(300)], [f"b{i}" for i in range(300)]]
    rng = random.Random(3)
    rows = [(i, " ".join(["x" if i % 2 else "y"] * 20 + [rng.choice(kinds[i % 2]) for _ in range(40)])) for i in range(200)]
    probes = [(1000, "x " * 5 + "a1 a2 a3 a4"), (1001, "x " * 5 + "b1 b2 b3 b4"), (1002, "y " * 5 + "a1 a2 a3 a4"), (1003, "y " * 5 + "b1 b2 b3 b4")]
    got = {r["doc_id"]: r["score"] for r in hmm.score(spark.createDataFrame(rows + probes, "doc_id long, text string"), F.col("doc_id") >= 1000, states=2, head_size=2).collect()}
    # both kinds of rare words stand on either side, so their frequencies cancel; a probe of two
    # kinds may change its state once, which costs it no more than one move
    assert got[1001] + got[1002] > got[1000] + got[1003] + 0.5


def test_hmm_is_a_distribution_over_words(spark):
    """One-word texts: the probabilities of all known words and an unseen one add up to those of two-token texts."""
    rows = [(i, w) for i, w in enumerate(["a a b", "b c", "c d e", "a"])]
    probe = [(100 + i, w) for i, w in enumerate(["a", "b", "c", "d", "e", "zzz"])]
    df = spark.createDataFrame(rows + probe, "doc_id long, text string")
    got = {r["doc_id"]: r for r in hmm.score(df, F.col("doc_id") >= 100, states=2, head_size=2, rounds=1).collect()}
    assert 0 < sum(10 ** got[100 + i]["score"] for i in range(6)) < 1


def test_hmm_without_training_or_rows(spark):
    df = spark.createDataFrame([(1, "x y")], "doc_id long, text string")
    (r,) = hmm.score(df, F.lit(True), states=2, rounds=1).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0) and r["score"] < 0
    assert hmm.score(df.filter("doc_id > 1"), F.lit(False), states=2, rounds=1).collect() == []


def corpus(n=200, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 80))]
        good = i % 4 != 0
        text = " ".join(w).capitalize() + "." if good else " ".join(x.upper() + "!!" for x in w[:3] * 10)
        rows.append((i, text, "en", 0.5))
        labels.append((i, int(good), 0))
    return [*rows, (n, None, None, None), (n + 1, "", None, 0.1)], labels


def test_quality_held_out_accuracy_and_edge_rows(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    stats = quality.document_statistics(docs)
    known = spark.createDataFrame([*labels, (999, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(stats, known, rows=F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r["score"] for r in quality.scored(stats, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    out = [(got[i], q) for i, q, _ in labels if i % 5 == 0]
    assert sum((s >= 0.3) == q for s, q in out) >= 0.95 * len(out)
    kept = quality.keep(quality.with_statistics(docs, "s"), model, 0.3, "s")
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s >= 0.3}
    assert quality.scored(quality.document_statistics(docs.limit(0)), model).collect() == []


def test_quality_without_two_classes(spark):
    stats = quality.document_statistics(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"))
    none = quality.train(stats, spark.createDataFrame([], "doc_id long, quality int"))
    one = quality.train(stats, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int"))
    assert [r["score"] for r in quality.scored(stats, none).collect()] == [0.5, 0.5]
    assert [r["score"] for r in quality.scored(stats, one).collect()] == [1.0, 1.0]


def test_discriminant_equals_a_direct_computation(spark):
    rng = np.random.default_rng(1)
    d = len(quality.NAMES)
    x = np.r_[rng.normal(0, 1, (60, d)), rng.normal(1, 2, (40, d))]
    y = np.r_[np.zeros(60), np.ones(40)]
    model = quality.fit(spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(x, y, strict=True)], "stats array<double>, label int"))
    own = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = 0.6 * own[0] + 0.4 * own[1]
    logs = []
    for c, share in ((0, 0.6), (1, 0.4)):
        s = (1 - quality.SHRINK_POOLED - quality.SHRINK_DIAGONAL) * own[c] + quality.SHRINK_POOLED * pooled + quality.SHRINK_DIAGONAL * np.diag(np.diag(pooled)) + 1e-9 * np.eye(d)
        z = x - x[y == c].mean(axis=0)
        logs.append(math.log(share) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -40, 40))), atol=1e-9)


def test_toxicity_learns_stems_and_reads_disguise(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        w = ["".join(rng.choice("bcdfgh") + rng.choice("aeu") for _ in range(rng.randint(1, 4))) for _ in range(40)]
        if i % 5 == 0:
            w.insert(rng.randrange(40), rng.choice(["zorkling", "zorkler", "Zorks"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    extra = [(900, "you z0rkling there"), (901, "you zоrkling there"), (902, "a class zorkling here"), (903, None), (904, ""), (905, "20 40")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    learnt = F.col("doc_id") % 3 != 0
    lexicon = toxicity.learn(docs, known, rows=learnt)
    assert any(e.startswith(b" zork") for e in lexicon.weights)
    lexicon.exceptions = ("class zorkling",)
    strength = toxicity.strengths(docs, lexicon)
    curve = toxicity.curve(strength, known, rows=learnt)
    got = {r["doc_id"]: r["score"] for r in strength.select("doc_id", curve.column(F.col("strength")).alias("score")).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.5) == t for i, t in labels if i % 3 == 0)
    assert got[900] >= 0.5 and got[901] >= 0.5
    assert max(got[902], got[903], got[904], got[905]) < 0.5


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, none)
    strength = toxicity.strengths(docs, lexicon)
    score = toxicity.curve(strength, none).column(F.col("strength"))
    assert [r[0] for r in strength.select(score).collect()] == [0.0]
    assert toxicity.strengths(docs.limit(0), lexicon).collect() == []


def test_folding():
    assert toxicity.fold(toxicity.plain("1D10T".encode())) == toxicity.fold(b"idiot")
    assert toxicity.fold(toxicity.plain("Ｉdiot".encode())) == b"idiot"
    lexicon = toxicity.Lexicon({b" idiot ": 2.0, b" 455 ": 1.0}, ("class idiot",))
    assert lexicon.matches(b"an 1d10t, a class idiot; idiots") == [(3, 2.0)]


def test_hmm_long_texts_are_regrouped_without_loss(monkeypatch):
    """Rows that pass in groups are the same rows; blocks hold several long texts, and counts are those of single texts."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    k, symbols = 3, 9
    monkeypatch.setattr(hmm, "LONG", 6)
    monkeypatch.setattr(hmm, "GROUP", 40)
    monkeypatch.setattr(hmm, "CELLS", 16)
    seqs = [rng.integers(1, symbols, int(n)).tolist() + [0] for n in rng.integers(0, 30, 40)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 8)), pa.array([np.array(s, dtype="<u2").tobytes() for s in seqs[i : i + 8]], type=pa.binary())], names=["row", "ids"]).slice(i // 8 % 2) for i in range(0, 40, 8)]
    got = list(hmm._regrouped(iter(batches), 1, symbols))
    told = {r: s for b in got for r, s in zip(b.column(0).to_pylist(), hmm._lists(b.column(1), symbols).to_pylist(), strict=True)}
    assert told == {r: seqs[r] for b in batches for r in b.column(0).to_pylist()} and sum(b.num_rows for b in got) == len(told)
    assert any(b.num_rows > 1 and min(map(len, hmm._lists(b.column(1), symbols).to_pylist())) > 6 for b in got)
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), size=k), rng.dirichlet(np.ones(symbols), size=k).T)
    each, all_ = ((np.zeros(k), np.zeros((k, k)), np.zeros((symbols, k))) for _ in range(2))
    for s in told.values():
        hmm._expected(model, np.array([len(s)]), np.array(s)[:, None], each)
    wide = 0
    for b in got:
        for _, size, ids in hmm._blocks(hmm._lists(b.column(1), symbols)):
            wide += len(size) > 1 and ids.size > 16
            hmm._expected(model, size, ids, all_)
    assert wide and all(np.allclose(a, b, rtol=1e-12) for a, b in zip(each, all_, strict=True))
