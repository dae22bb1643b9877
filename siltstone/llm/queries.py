"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontamination, hmm, jaccard, mixing, negatives, periodicity, quality, sharding, simhash, substrings, surrogates, topk, toxicity
from siltstone.shared import read_table, store

KEY = "siltstone"
SHARDS = 24


def _remainder(divisor: int, column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % divisor


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words in passages of 50 words and more that repeat elsewhere."""
    found = substrings.repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_repeated", F.size("spans").cast("long").alias("n_passages"), "spans", "class_id", (F.col("n_repeated") > 0).alias("repeated"))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates for personal data and secrets."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.pseudonymise(docs, KEY).select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside ten-word windows of benchmark items."""
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    marked = decontamination.mark(docs.select("doc_id", "text"), items)
    names = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under a hidden Markov model."""
    return hmm.score(read_table(spark, sf_dir, "documents"), _remainder(7) == 2)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 24 and slot, by the law of equal row counts."""
    text = F.coalesce("text", F.lit(""))
    rows = read_table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.shard_rows(rows, SHARDS, KEY, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learnt from the labels that are not held out."""
    stats = store(quality.document_statistics(read_table(spark, sf_dir, "documents")), "op6-stats")
    model = quality.train(stats, read_table(spark, sf_dir, "labels"), rows=_remainder(5) != 0)
    found = quality.scored(stats, model)
    return found.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component under Jaccard similarity of 0.75 of five-word shingles."""
    return jaccard.join(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from the labels that are not held out."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    learnt = _remainder(5) != 0
    lexicon = toxicity.learn(docs, labels, rows=learnt)
    strength = store(toxicity.strengths(docs, lexicon), "op8-strengths")
    score = toxicity.curve(strength, labels, rows=learnt).column(F.col("strength"))
    return strength.select("doc_id", (_remainder(5) == 0).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0, seed=KEY)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best others for every hundredth vector."""
    return topk.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hard negatives for each of five positives of every hundredth vector."""
    vectors = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0, moved)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component at four differing bits or fewer."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where every tenth text, by a hash of its id, repeats a part of itself up to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    told = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    told = told.withColumns({"n": F.size("w"), "g": F.floor(F.col("h") / 10)}).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    told = told.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    turns = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), turns))
    made = F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), F.lit(1), F.col("n")), " ")
    return told.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op13_periodicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs of words, the longest of them, and digests of
    the runs and of the text without their repetitions."""
    found = periodicity.periodic_runs(planted_runs(read_table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), periodicity.longest(F.col("runs")).alias("r"), F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return told.select("doc_id", "n_runs", "r.start", "r.length", "r.period", F.floor(1000 * F.col("r.length") / F.col("r.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {
    "op1_substrings": op1_substrings,
    "op2_surrogates": op2_surrogates,
    "op3_decontamination": op3_decontamination,
    "op4_hmm": op4_hmm,
    "op5_sharding": op5_sharding,
    "op6_quality": op6_quality,
    "op7_jaccard": op7_jaccard,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_topk": op10_topk,
    "op11_negatives": op11_negatives,
    "op12_simhash": op12_simhash,
    "op13_periodicity": op13_periodicity,
}

ORACLE_SQL = {
    "op7_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 75 * (na.n + nb.n - o)),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
""",
    "op3_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p))),
h AS (SELECT s.doc_id, s.i, s.n, p.item_id FROM s JOIN p USING (n, phrase)),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
""",
    "op10_topk": """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.r <> q.r AND len(c.e) = len(q.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS "rank", vec_id, score FROM r WHERE n <= 10
""",
    "op11_negatives": """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, c.r AS c, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.r <> c.r AND len(a.e) = len(c.e)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, c) AS nth FROM s WHERE same) WHERE nth <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.vec_id, s.c) AS nth
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, nth::INTEGER AS "rank", negative_id, positive_score, negative_score FROM n WHERE nth <= 5
""",
}
