"""Search queries over documents, embeddings and parts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import STOP_WORDS, excerpt, query_terms, tokenize, tokens_of
from siltstone.functions.vectors import cosine
from siltstone.operators import search, term_index
from siltstone.shared import read_table, spread

QUERY = "from by on of"
TERMS = query_terms(QUERY)


def chunks(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """Documents as chunks: one each, grouped by source; the tables hold text in
    compatibility form already. A document has the vector with its number, if any."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), "doc_id")
    none = F.lit("")
    out = docs.select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("documentId"), F.col("lang").alias("title"), none.alias("parentTitle"), none.alias("heading"), none.alias("url"),
        F.col("text").alias("content"), F.col("text").alias("contextualText"), tokenize(F.col("text")).alias("tokens"), F.col("doc_id").alias("chunk_pos"),
    )
    if not vectors:
        return out.withColumn("embedding", F.lit(None).cast("array<float>"))
    held = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_pos"), "embedding")
    return out.join(held, "chunk_pos", "left")


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve best documents, at most three of a source, without weak ones."""
    found = term_index.search_stored(term_index.build(chunks(spark, sf_dir)), QUERY)
    return found.select(F.col("chunk_pos").alias("doc_id"), F.col("documentId").alias("source"), F.round("score", 6).alias("score"), F.round("lexicalScore", 6).alias("lexical_score"))


def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and normalised BM25 of all documents."""
    told = search.normalized(search.bm25(chunks(spark, sf_dir), TERMS), norm="bm25")
    return told.select(F.col("chunk_pos").alias("doc_id"), F.round("bm25", 6).alias("bm25"), F.round("norm", 6).alias("norm"))


def document_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each token occurs, and how often in all."""
    each = chunks(spark, sf_dir).select("chunk_pos", F.explode("tokens").alias("token"))
    # once by document and token, then by token: both aggregates combine before they shuffle
    once = each.groupBy("token", "chunk_pos").agg(F.count("*").alias("tf"))
    return once.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.statistics(chunks(spark, sf_dir), TERMS).select("n", F.round("avg_len", 6).alias("avg_len"), F.array_join(F.transform("df", lambda d: d.cast("string")), ",").alias("df"))


def lexical_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched terms, longest run and the gate of every document."""
    df = chunks(spark, sf_dir)
    matched = F.size(F.array_intersect(search._array(TERMS), F.col("tokens")))
    run = search.longest_run(TERMS, F.col("tokens"))
    exact = F.contains(F.lower("contextualText"), F.lit(QUERY))
    passes = search.lexical_gate(len(TERMS), exact, matched, run, F.lit(0))
    return df.select(F.col("chunk_pos").alias("doc_id"), matched.alias("matched"), run.alias("run"), passes.alias("passes"))


def _with_vector_0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors with that of row 0, by a broadcast of one row; none if there is no row 0."""
    vectors = read_table(spark, sf_dir, "embeddings")
    one = vectors.filter("vec_id = 0").agg(F.first("embedding").alias("query")).filter("query is not null")
    return search._with_row(vectors.select("vec_id", "embedding"), one)


def cosine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cosine with vector 0."""
    return _with_vector_0(spark, sf_dir).select("vec_id", F.round(cosine(F.col("embedding"), F.col("query")), 6).alias("similarity"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors closest to vector 0."""
    ranked = _with_vector_0(spark, sf_dir).select("vec_id", cosine(F.col("embedding"), F.col("query")).alias("raw")).orderBy(F.desc("raw"), "vec_id").limit(10)
    return ranked.select("vec_id", F.round("raw", 6).alias("similarity"))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and vectors together; documents without a vector go by words alone."""
    vector = read_table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").head()
    index = term_index.build(chunks(spark, sf_dir, vectors=True))
    found = term_index.search_stored(index, QUERY, list(vector[0]) if vector else None)
    return found.select(F.col("chunk_pos").alias("doc_id"), F.round("score", 6).alias("score"), F.round("semanticScore", 6).alias("semantic_score"))


def metadata_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name or type match, best first."""
    part = read_table(spark, sf_dir, "part")
    docs = part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("parentTitle"), F.col("p_partkey").alias("doc_pos"))
    own = docs.select(F.concat("id", F.lit(":0")).alias("id"), F.col("id").alias("documentId"), "title", "parentTitle", F.lit("").alias("heading"), F.lit("").alias("url"), F.col("title").alias("content"), F.col("doc_pos").alias("chunk_pos"))
    found = search.search_metadata(docs, own, "red widget economy")
    return found.select(F.col("chunk_pos").alias("p_partkey"), "title", F.round("score", 6).alias("score"), F.round("lexicalScore", 6).alias("lexical_score"))


def search_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query that words do not find: it falls through to titles."""
    df = chunks(spark, sf_dir)
    docs = df.groupBy("documentId").agg(F.min("chunk_pos").alias("doc_pos")).select(F.col("documentId").alias("id"), F.col("documentId").alias("title"), F.lit("").alias("parentTitle"), "doc_pos")
    found = search.search(docs, df, "src11 qqqqq")
    return found.select(F.col("chunk_pos").alias("doc_id"), "strategy", "effective_query", F.round("score", 6).alias("score"))


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """520 characters around the first word of the query."""
    words = F.array(*map(F.lit, tokens_of("through between " + QUERY)))
    return read_table(spark, sf_dir, "documents").select("doc_id", excerpt(F.col("text"), words).alias("excerpt"))


QUERIES = {f.__name__: f for f in (bm25_search, bm25_scores, document_frequencies, corpus_statistics, lexical_gate, cosine_scores, cosine_topk, hybrid_search, metadata_search, search_cascade, excerpts)}

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS if w.isascii())
_TOKENS = f"""
t AS (SELECT doc_id, source, lang, text, list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9._+-]*'), lambda w: NOT list_contains([{_STOP}], w)) AS tokens FROM documents),
"""
_TERM_ROWS = ", ".join(f"({i + 1}, '{t}')" for i, t in enumerate(TERMS))
_BM25 = f"""{_TOKENS}
q(i, term) AS (VALUES {_TERM_ROWS}),
s AS (SELECT count(*)::DOUBLE AS n, avg(len(tokens)) AS avg_len FROM t),
f AS (SELECT doc_id, i, term, len(list_filter(tokens, lambda w: w = term)) AS tf, len(tokens) AS size FROM t, q),
d AS (SELECT i, count(*) FILTER (tf > 0) AS df FROM f GROUP BY i),
b AS (SELECT doc_id, sum(CASE WHEN tf > 0 THEN ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / greatest(avg_len, 1))) ELSE 0::DOUBLE END ORDER BY i) AS bm25,
      count(*) FILTER (tf > 0) AS matched, list(tf > 0 ORDER BY i) AS has FROM f JOIN d USING (i), s GROUP BY doc_id),
x AS (SELECT *, CASE WHEN max(bm25) OVER () = min(bm25) OVER () THEN CASE WHEN bm25 > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END
      ELSE (bm25 - min(bm25) OVER ()) / (max(bm25) OVER () - min(bm25) OVER ()) END AS norm FROM b),
r AS (SELECT doc_id, max(run) AS run FROM (SELECT doc_id, i - g AS gap, count(*) FILTER (h) AS run FROM
      (SELECT doc_id, i, h, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, tf > 0 AS h FROM f)) WHERE h GROUP BY doc_id, gap) GROUP BY doc_id),
g AS (SELECT t.doc_id, t.source, bm25, norm, matched, coalesce(run, 0) AS run, contains(lower(t.text), '{QUERY}') AS exact,
      len(list_filter([{", ".join(f"'{w}'" for w in TERMS)}], lambda w: contains(lower(t.lang), w))) AS in_title
      FROM x JOIN t USING (doc_id) LEFT JOIN r USING (doc_id)),
p AS (SELECT *, exact OR (matched >= 2 AND matched / 4.0 >= 0.45 AND (run >= 2 OR in_title >= 2)) AS passes FROM g)
"""
_RANK = """,
c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS nth FROM z),
k AS (SELECT * FROM c WHERE nth <= 3 ORDER BY score DESC, doc_id LIMIT 12),
o AS (SELECT *, least(0.99::DOUBLE, score / (SELECT max(score) FROM k)) AS rel FROM k)
"""
_BOOST = "least(0.2::DOUBLE, matched / 4.0::DOUBLE * 0.2::DOUBLE) + least(0.12::DOUBLE, in_title / 4.0::DOUBLE * 0.12::DOUBLE) + CASE WHEN exact THEN 0.14::DOUBLE ELSE 0::DOUBLE END"
_COSINE = "list_inner_product(e::DOUBLE[], v::DOUBLE[]) / (sqrt(list_inner_product(e::DOUBLE[], e::DOUBLE[])) * sqrt(list_inner_product(v::DOUBLE[], v::DOUBLE[])))"

ORACLE_SQL = {
    "bm25_search": f"WITH {_BM25}, z AS (SELECT *, norm + {_BOOST} AS score FROM p WHERE passes) {_RANK} SELECT doc_id, source, round(rel, 6) AS score, round(norm, 6) AS lexical_score FROM o WHERE rel >= 0.6",
    "bm25_scores": f"WITH {_BM25} SELECT doc_id, round(bm25, 6) AS bm25, round(norm, 6) AS norm FROM x",
    "document_frequencies": f"WITH {_TOKENS} u AS (SELECT doc_id, unnest(tokens) AS token FROM t) SELECT token, count(DISTINCT doc_id) AS df, count(*) AS cf FROM u GROUP BY token",
    "corpus_statistics": f"WITH {_BM25} SELECT (SELECT n::BIGINT FROM s) AS n, (SELECT round(avg_len, 6) FROM s) AS avg_len, string_agg(df::VARCHAR, ',' ORDER BY i) AS df FROM d",
    "lexical_gate": f"WITH {_BM25} SELECT doc_id, matched::INTEGER AS matched, run::INTEGER AS run, passes FROM p",
    "cosine_scores": f"SELECT vec_id, round({_COSINE}, 6) AS similarity FROM (SELECT vec_id, embedding AS e, (SELECT embedding FROM embeddings WHERE vec_id = 0) AS v FROM embeddings)",
    "cosine_topk": f"SELECT vec_id, round({_COSINE}, 6) AS similarity FROM (SELECT vec_id, embedding AS e, (SELECT embedding FROM embeddings WHERE vec_id = 0) AS v FROM embeddings) ORDER BY {_COSINE} DESC, vec_id LIMIT 10",
    "hybrid_search": f"""WITH {_BM25},
m AS (SELECT p.*, lower(t.text) AS low, {_COSINE.replace("e::", "em.embedding::").replace("v::", "qv.embedding::")} AS raw, em.embedding IS NOT NULL AS has
      FROM p JOIN t USING (doc_id) LEFT JOIN embeddings em ON em.vec_id = p.doc_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) qv),
w AS (SELECT *, coalesce(raw, 0) AS sim FROM m),
y AS (SELECT *, (sim - min(sim) OVER ()) / (max(sim) OVER () - min(sim) OVER ()) AS sem,
      has AND sim >= 0.88 AND {" AND ".join(f"contains(low, '{t}')" for t in TERMS)} AS meant FROM w),
z AS (SELECT *, norm * CASE WHEN has THEN 0.48::DOUBLE ELSE 1::DOUBLE END + CASE WHEN meant THEN sem * 0.32::DOUBLE + sim * 0.2::DOUBLE ELSE 0::DOUBLE END + {_BOOST} AS score FROM y WHERE passes OR meant) {_RANK}
SELECT doc_id, round(rel, 6) AS score, round(sem, 6) AS semantic_score FROM o WHERE rel >= 0.6""",
    "metadata_search": """WITH m AS (SELECT p_partkey, p_name AS title, len(list_filter(['red', 'widget', 'economy'], lambda w: contains(lower(p_name || ' ' || p_type), w))) AS hits, contains(lower(p_name), 'red widget economy') AS exact FROM part),
r AS (SELECT *, hits / 3.0::DOUBLE + CASE WHEN exact THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS raw FROM m WHERE exact OR hits >= 2)
SELECT p_partkey, title, round(least(0.99::DOUBLE, raw / (SELECT max(raw) FROM r)), 6) AS score, round(least(1::DOUBLE, hits / 3.0::DOUBLE), 6) AS lexical_score FROM r ORDER BY raw DESC, p_partkey LIMIT 12""",
    "search_cascade": """SELECT min(doc_id) AS doc_id, 'metadata' AS strategy, 'src11 qqqqq' AS effective_query, 0.99::DOUBLE AS score FROM documents WHERE source = 'src11' HAVING count(*) > 0""",
    "excerpts": rf"""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
p AS (SELECT doc_id, t, list_filter([{", ".join(f"strpos(lower(t), '{w}')" for w in tokens_of("through between " + QUERY) if len(w) > 1)}], lambda x: x > 0)[1] - 1 AS pos FROM c),
s AS (SELECT *, greatest(0, pos - 160) AS a FROM p)
SELECT doc_id, CASE WHEN pos IS NULL OR length(t) <= 500 THEN substr(t, 1, 520) ELSE
  CASE WHEN a > 0 THEN '…' ELSE '' END || substr(t, a + 1, 520) || CASE WHEN a + 520 < length(t) THEN '…' ELSE '' END END AS excerpt FROM s""",
}
