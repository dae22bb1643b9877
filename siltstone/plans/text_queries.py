"""Text, chunk, conversation and event queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import clean_markdown, redact
from siltstone.operators import chunking, conversations
from siltstone.shared import read_table, spread
from siltstone.streaming import rate_limit


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), "doc_id")
    headed = F.concat(F.lit("# "), "source", F.lit("\n"), "text", F.lit("\n\n## Tail\n"), "lang")
    return docs.select(F.col("doc_id").cast("string").alias("documentId"), F.lit("").alias("nodeToken"), F.col("source").alias("title"), F.lit("").alias("parentTitle"), F.lit("").alias("url"), headed.alias("markdown"), "doc_id")


def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and content of every section."""
    each = _markdown(spark, sf_dir).select("doc_id", F.posexplode(chunking.sections(F.col("markdown"))).alias("pos", "s"))
    return each.select("doc_id", "pos", "s.heading", F.length("s.content").cast("long").alias("n_chars"), F.md5("s.content").alias("content_md5"))


def overlap_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in overlapping pieces."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    each = docs.select("doc_id", F.posexplode(chunking.pieces(F.col("text"))).alias("pos", "piece"))
    return each.select("doc_id", "pos", F.length("piece").cast("long").alias("n_chars"), F.md5("piece").alias("piece_md5"))


def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, tokens and characters by source, after sections, pieces and context."""
    made = chunking.chunk_documents(_markdown(spark, sf_dir))
    return made.groupBy("title").agg(F.count("*").alias("n_chunks"), F.count_distinct("documentId").alias("n_documents"), F.max("ordinal").alias("last_ordinal"))


def markdown_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without tags."""
    return read_table(spark, sf_dir, "pages").select("page_id", F.md5(clean_markdown(F.col("html"))).alias("clean_md5"))


def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which a secret is blanked."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", redact(F.col("text")).alias("redacted"))
    return docs.filter("text != redacted").select("doc_id", F.md5("redacted").alias("redacted_md5"))


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


def conversation_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.export(read_table(spark, sf_dir, "conversations"))


def latest_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.latest_question(read_table(spark, sf_dir, "conversations"))


def conversation_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.validity(read_table(spark, sf_dir, "conversations"))


def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each turn could be a search: one to 500 characters without the blanks around."""
    turns = read_table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.coalesce(conversations.query_ok(F.col("text")), F.lit(False)).alias("ok"))


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.trace(read_table(spark, sf_dir, "conversations"))


def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event against five in six hours for each user; some have no time stamp."""
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 97 != 0, F.col("ts")).alias("ts"))
    told = rate_limit.limited(events, "user_id", "ts", 5, 6 * 3600, "event_id")
    return told.select("event_id", "user_id", "allowed", "remaining", F.unix_micros("reset_at").alias("reset_us"))


def request_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events each hashed key has."""
    events = read_table(spark, sf_dir, "events")
    key = rate_limit.request_key(F.col("event_type"), F.col("user_id").cast("string"), F.col("props"))
    return events.groupBy(key.alias("key")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (section_split, overlap_pieces, chunk_counts, markdown_cleaning, redaction, content_hashes, conversation_export, latest_questions, conversation_validity, search_requests, trace_events, rate_limits, request_keys)}

_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?i)</?(?:callout|grid|column)\b[^>]*>', '', 'g'), '!\[([^\]]*)\]\([^)]+\)', '\1', 'g'),
'https://internal-api-drive-stream\.feishu\.cn/\S+', '', 'g'), '<[^>]+>', ' ', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"""
_PIECES = r"""
p AS (SELECT {key}, content, length(content) AS n, 0 AS start, 0 AS step, NULL::VARCHAR AS piece, length(content) <= 430 AS whole FROM src
  UNION ALL
  SELECT {key}, content, n, CASE WHEN cut >= n THEN n ELSE greatest(cut - 70, start + 1) END, step + 1, trim(substr(content, start + 1, cut - start), ' ' || chr(9) || chr(10) || chr(13)), FALSE
  FROM (SELECT *, CASE WHEN ideal < n AND b >= start + 400 THEN b + 1 ELSE ideal END AS cut
        FROM (SELECT *, greatest(CASE WHEN strpos(reverse(substr(content, start + 1, ideal - start + 2)), chr(10) || chr(10)) > 0 THEN start + (ideal - start + 2) - strpos(reverse(substr(content, start + 1, least(ideal - start + 2, n - start))), chr(10) || chr(10)) - 1 ELSE -1 END, -1) AS b
              FROM (SELECT *, least(start + 430, n) AS ideal FROM p WHERE NOT whole AND start < n)))),
"""
ORACLE_SQL = {
    "section_split": rf"""WITH c AS (SELECT doc_id, source, lang, {_CLEAN.format("text")} AS t FROM documents)
SELECT doc_id, 0 AS pos, source AS heading, length(t)::BIGINT AS n_chars, md5(t) AS content_md5 FROM c WHERE t <> ''
UNION ALL SELECT doc_id, CASE WHEN t <> '' THEN 1 ELSE 0 END, 'Tail', length(lang)::BIGINT, md5(lang) FROM c""",
    "overlap_pieces": rf"""WITH RECURSIVE src AS (SELECT doc_id, text AS content FROM documents), {_PIECES.format(key="doc_id")}
o AS (SELECT doc_id, content AS piece, 0 AS step FROM p WHERE whole UNION ALL SELECT doc_id, piece, step FROM p WHERE NOT whole AND piece <> '')
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1)::INTEGER AS pos, length(piece)::BIGINT AS n_chars, md5(piece) AS piece_md5 FROM o""",
    "chunk_counts": rf"""WITH RECURSIVE src AS (SELECT doc_id, source, {_CLEAN.format("text")} AS content FROM documents), {_PIECES.format(key="doc_id, source")}
o AS (SELECT doc_id, source, content AS piece, 0 AS step FROM p WHERE whole AND content <> '' UNION ALL SELECT doc_id, source, piece, step FROM p WHERE NOT whole AND piece <> ''),
k AS (SELECT d.doc_id, d.source, count(o.piece) + 1 AS n FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id GROUP BY ALL)
SELECT source AS title, sum(n)::BIGINT AS n_chunks, count(*) AS n_documents, (max(n) - 1)::INTEGER AS last_ordinal FROM k GROUP BY source""",
    "markdown_cleaning": rf"SELECT page_id, md5({_CLEAN.format('html')}) AS clean_md5 FROM pages",
    "redaction": r"""WITH r AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(text, '(Bearer\s+)[A-Za-z0-9._~+/=-]+', '\1[REDACTED]', 'gi'),
'([?&](?:token|key|api_key|apikey|signature|secret|password)=)[^&\s]+', '\1[REDACTED]', 'gi'),
'((?:api[_-]?key|secret[_-]?key|access[_-]?token|refresh[_-]?token|token|password)\s*[:=]\s*)[^\s,;]+', '\1[REDACTED]', 'gi') AS t FROM documents)
SELECT doc_id, md5(t) AS redacted_md5 FROM r WHERE t <> text""",
    "content_hashes": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "conversation_export": "SELECT conv_id, string_agg('**' || upper(role[1]) || role[2:] || ':** ' || text, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id",
    "latest_questions": "SELECT conv_id, trim(arg_max(text, turn), ' ' || chr(9) || chr(10) || chr(13)) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id",
    "conversation_validity": """WITH v AS (SELECT conv_id, count(*) AS n_messages, sum(length(text))::BIGINT AS n_chars, bool_and(role IN ('user', 'assistant')) AS roles_ok, bool_and(length(text) BETWEEN 1 AND 8000) AS lengths_ok, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id)
SELECT *, roles_ok AND lengths_ok AND last_role = 'user' AND n_messages <= 24 AND n_chars <= 32000 AS valid FROM v""",
    "search_requests": "SELECT conv_id, turn, coalesce(length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) BETWEEN 1 AND 500, FALSE) AS ok FROM conversations",
    "trace_events": "SELECT conv_id, turn, substr(sha256(text), 1, 16) AS query_hash, length(text)::INTEGER AS query_length FROM conversations WHERE role = 'user'",
    "rate_limits": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_id % 97 <> 0 AND ts IS NOT NULL),
r AS (SELECT event_id, user_id, i, 1 AS n, t + 21600000000 AS reset FROM e WHERE i = 1
  UNION ALL SELECT e.event_id, e.user_id, e.i, CASE WHEN r.reset <= e.t THEN 1 ELSE r.n + 1 END, CASE WHEN r.reset <= e.t THEN e.t + 21600000000 ELSE r.reset END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT event_id, user_id, n <= 5 AS allowed, greatest(0, 5 - n)::INTEGER AS remaining, reset::BIGINT AS reset_us FROM r
UNION ALL SELECT event_id, user_id, FALSE, 0, NULL FROM events WHERE event_id % 97 = 0 OR ts IS NULL""",
    "request_keys": "SELECT event_type || ':' || substr(sha256(coalesce(user_id::VARCHAR, 'unknown') || '|' || coalesce(props, '')), 1, 24) AS key, count(*) AS n FROM events GROUP BY 1",
}
