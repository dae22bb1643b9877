"""The corpus pipeline: quality, near duplicates, benchmarks, mixing, shards.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns the columns of documents; the last adds shard and slot. Results are
written as Parquet and read again between stages, so a stage first deletes the
intermediate tables of those before it.

Cases, in all stages: a null text counts as empty; an empty text has a quality
score like any other, is nobody's near duplicate, holds no benchmark and is not
taken by the mix, as it has no words; texts of any length are taken whole; rows
are told apart by number, not by id, so rows without an id, or with one id and
different texts, are judged each; of equal texts one row stays; of a group of
near duplicates the row with the smallest id stays (one without an id only if
none has one); empty tables give no rows; further columns are kept as they are,
whatever their names, but for shard and slot, which the last stage replaces;
names that begin with two underscores are ours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontamination, jaccard, mixing, quality, sharding
from siltstone.shared import discard, read_table, small_batches, stage_tables, store

LEAST_QUALITY = 0.3
KEY = "siltstone"
SHARDS = 24
_tables = stage_tables()


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the discriminant, learnt from all labels, rejects."""
    with _tables.begin(docs):
        with small_batches(spark):
            known = store(quality.with_statistics(docs, "__stats"), "quality")
        model = quality.train(known.select("doc_id", F.col("__stats").alias("stats")), read_table(spark, sf_dir, "labels"))
        return quality.keep(known, model, LEAST_QUALITY, "__stats")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest id, and of several rows
    with this id one of them."""
    with _tables.begin(docs):
        rows = store(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
        groups = jaccard.join(rows, id_col="__row").select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__group"))
        named = groups.join(rows.select("__row", "doc_id"), "__row")
        first = named.groupBy("__group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("first"))
        kept = store(first.select(F.col("first.__row").alias("__row")), "kept")
        return rows.join(kept.hint("merge"), "__row", "left_semi").select(*docs.columns)


def no_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a window of a benchmark item."""
    with _tables.begin(docs):
        marked = decontamination.mark(docs, read_table(spark, sf_dir, "benchmark"), names=("__n_words", "__n_hit", "__items"))
        return marked.filter("__n_hit = 0").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    with _tables.begin(docs):
        taken = mixing.mix(docs, weights=(3, 1, 2), share=1.5, most=2.0, seed=KEY, prefix="__").filter("__copies > 0")
        return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With each row's shard and slot in a reproducible shuffle."""
    with _tables.begin(docs):
        return sharding.shard_rows(docs, SHARDS, KEY, [F.col("doc_id"), F.xxhash64("text")])


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", no_benchmarks),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]

# The first stage is a trained classifier, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store(docs, f"stage{i}")
            discard(before)
            before = docs
    return docs
