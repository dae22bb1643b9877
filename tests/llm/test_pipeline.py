"""Cases of the pipeline's stages: ids, nulls, names, lengths, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, items string, n_hit long, target double, taken long, copies long, pattern string, words string, stats string"
CLASHING = (99, "keep", 98, 97.0, 96, 95, "p", "w", "s")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(60)) for _ in range(n))
    item = say(14)
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    same, base = say(60), say(200).split()
    near = [*base]
    near[100] = "changed"
    rows = [
        (1, say(80)), (1, say(80)), (1, say(80)),  # one id, three texts
        (2, same), (2, same), (3, same), (None, same),  # copies, one without an id
        (None, say(50)), (None, say(50)),
        (4, " ".join(base)), (5, " ".join(near)),
        (6, say(20) + " " + item + " " + say(20)),
        (7, ""), (8, None), (9, say(30_000)),
    ]
    found = [(i, t, "en", "ab"[k % 2] if k else None, 7, *CLASHING) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(found, SCHEMA).write.parquet(f"{at}/documents.parquet")
    return str(at), rows, item


def stage(name):
    return next(f for n, f in pipeline.STAGES if name in n)


def told(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_near_duplicates_judges_rows_not_ids(spark, folder):
    at, rows, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    got = stage("Jaccard")(spark, docs, at)
    assert got.columns == docs.columns
    out = [k for k in range(len(rows)) if k not in (4, 5, 6, 10)]
    assert told(got) == sorted((rows[k] for k in out), key=str)


def test_stages_keep_columns_of_clashing_names(spark, folder):
    at, rows, item = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name in ("quality", "Jaccard", "benchmark", "mixing"):
        got = stage(name)(spark, docs, at)
        assert got.schema.names == docs.schema.names
        assert {tuple(r)[5:] for r in got.collect()} == {CLASHING}
    clean = stage("benchmark")(spark, docs, at)
    assert told(clean) == sorted((r for r in rows if item not in (r[1] or "")), key=str)


def test_mixed_and_sharded_rows(spark, folder):
    at, rows, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    mix = [x for x in told(stage("mixing")(spark, docs, at))]
    assert all((x[1] or "").split() for x in mix) and max(mix.count(x) for x in mix) <= 4  # two equal rows, twice each
    out = stage("sharding")(spark, docs.withColumns({"shard": F.lit("mine"), "slot": F.lit("mine")}), at).collect()
    assert len(out) == len(rows) and len({(r["shard"], r["slot"]) for r in out}) == len(rows)


def test_empty_tables(spark, folder, tmp_path):
    at, *_ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{at}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    got = pipeline.run(spark, str(tmp_path))
    assert got.collect() == [] and got.columns[-2:] == ["shard", "slot"]
    # without labels or benchmark, nothing is rejected for them
    docs = spark.read.parquet(f"{at}/documents.parquet")
    assert stage("quality")(spark, docs, str(tmp_path)).count() == docs.count()
    assert stage("benchmark")(spark, docs, str(tmp_path)).count() == docs.count()
