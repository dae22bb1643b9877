"""The registered queries and the pipeline over a small table, against brute force or SQL."""

import glob
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import mixing, quality, queries, sharding, surrogates
from siltstone.llm.text import words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="module")
def docs(tables):
    return tables.sql("SELECT doc_id, text, source FROM documents").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, tables, name):
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = tables.sql(queries.ORACLE_SQL[name])
    assert columns == sorted(want.columns)
    mine, theirs = (sorted(map(str, rows)) for rows in ([tuple(r) for r in found.select(*columns).collect()], want.select(*[f'"{c}"' for c in columns]).fetchall()))
    assert mine == theirs


def passages(docs):
    seen, held = {}, {}
    for i, text, _ in docs:
        held[i] = words((text or "").encode())
        for k in range(len(held[i]) - 49):
            seen.setdefault(tuple(held[i][k : k + 50]), set()).add(i)
    return {i for w in seen.values() if len(w) > 1 for i in w}, held


def test_op1(spark, docs):
    got = {r["doc_id"]: r for r in queries.op1_substrings(spark, SF).collect()}
    equal, held = passages(docs)
    assert set(got) == set(held) and all(got[i]["repeated"] for i in equal)
    assert all(r["n_words"] == len(held[i]) for i, r in got.items())


def test_op2(spark, docs):
    got = {r["doc_id"]: r for r in queries.op2_surrogates(spark, SF).collect()}
    made = {}
    for i, text, _ in docs:
        found = surrogates.find(text)
        assert got[i]["n_entities"] == len(found)
        for (a, z, kind), e in zip(found, got[i]["entities"], strict=True):
            new = got[i]["text"][e["start"] : e["end"]]
            assert new != text[a:z] and made.setdefault((kind, text[a:z]), new) == new
    assert made and len(set(made.values())) == len(made) and not set(made.values()) & {v for _, v in made}


def test_op4(spark, docs):
    counts = Counter()
    for i, text, _ in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*words((text or "").encode()), b""])
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in queries.op4_hmm(spark, SF).collect()}
    for i, text, _ in docs:
        tokens = [*words((text or "").encode()), b""]
        r = got[i]
        assert (r["n_tokens"], r["train_tokens"], r["n_known"]) == (len(tokens), n, sum(counts[w] > 0 for w in tokens))
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_op5(spark, docs):
    got = {r["doc_id"]: r for r in queries.op5_sharding(spark, SF).collect()}
    order = sorted(i for i, _, _ in docs)
    places = dict(zip(order, sharding.permute(np.arange(len(order)), len(order), queries.KEY).tolist(), strict=True))
    for i, text, _ in docs:
        r, raw = got[i], (text or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        assert (r["shard"], r["slot"]) == (places[i] % 24, places[i] // 24)


@pytest.mark.parametrize(("name", "label", "least"), [("op6_quality", "quality", 0.8), ("op8_toxicity", "toxic", 0.7)])
def test_classifiers(spark, tables, name, label, least):
    got = {r["doc_id"]: r for r in queries.QUERIES[name](spark, SF).collect()}
    cut = 0.3 if label == "quality" else 0.5
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    known = tables.sql(f"SELECT doc_id, {label} FROM labels").fetchall()
    out = [(i, y) for i, y in known if got[i]["held_out"]]  # nothing was learnt from these
    assert len(out) > 10 and sum(got[i]["predicted"] == y for i, y in out) >= least * len(out)


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_op9(spark, docs):
    got = {r["doc_id"]: r for r in queries.op9_mixing(spark, SF).collect()}
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += size(text)
    target = mixing.quotas(list(sizes.items()), (3, 1, 2), 1.5, 2.0)
    taken, largest = Counter(), Counter()
    for i, text, source in docs:
        r = got[i]
        assert (r["size"], r["source_size"]) == (size(text), sizes[source]) and math.isclose(r["target"], target[source]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
        largest[source] = max(largest[source], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in sizes)


def shingles(text):
    w = words((text or "").encode())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_equals_brute_force(spark, tables):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: tuple(r) for r in source.collect()}
    at, names = source.columns.index("text"), source.columns
    text = lambda i: rows[i][at]
    # 1: statistics and a model fitted on the driver's side of the same labels
    stats = spark.createDataFrame([(i, list(map(float, quality.statistics((text(i) or "").encode())))) for i in rows], "doc_id long, stats array<double>")
    model = quality.train(stats, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = [i for i in rows if model.score(np.array([quality.statistics((text(i) or "").encode())]))[0] >= 0.3]
    assert 0 < len(kept) < len(rows)
    # 2: the least of each component stays
    sets, least = {i: shingles(text(i)) for i in kept}, {i: i for i in kept}
    edges = [(a, b) for a in kept for b in kept if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in kept:
        before = dict(least)
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    kept = [i for i in kept if least[i] == i]
    # 3: no window of a benchmark item
    said = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for (t,) in tables.sql("SELECT text FROM benchmark").fetchall():
        w = said(t)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    lengths = {len(w) for w in windows}
    kept = [i for i in kept if not any(tuple(said(text(i))[k : k + n]) in windows for n in lengths for k in range(len(said(text(i))) - n + 1))]
    # 4: as often as the mix takes it; 5: every row at its place
    left = source.filter(F.col("doc_id").isin(kept))
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(left, seed=corpus_pipeline.KEY).collect()}
    out = sorted(i for i in kept for _ in range(taken[i]))
    places = sharding.permute(np.arange(len(out)), len(out), corpus_pipeline.KEY).tolist()
    want = sorted((*rows[i], p % 24, p // 24) for i, p in zip(out, places, strict=True))
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == [*names, "shard", "slot"]
    got = sorted(tuple(r) for r in found.collect())
    # equal rows share their order, so compare which places each document has
    assert [g[: len(names)] for g in got] == [w[: len(names)] for w in want]
    assert sorted(g[len(names) :] for g in got) == sorted(w[len(names) :] for w in want)


def test_stages_are_as_dealt():
    assert len(corpus_pipeline.STAGES) == 5 and all(callable(f) for _, f in corpus_pipeline.STAGES)
