"""Link, tree, citation and sync queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import urls
from siltstone.operators import ingest, links, sync
from siltstone.shared import read_table, shared_dir


def url_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical form and domain of every page's URL."""
    pages = read_table(spark, sf_dir, "pages")
    clean = pages.select("page_id", urls.sanitize(F.concat("url", F.when(F.contains("url", F.lit("?")), F.when(F.col("page_id") % 2 == 0, "&token=1&x=2)").otherwise("&%74oken=1&x=2)")).otherwise("?utm_x=1&a=b)"))).alias("clean"))
    return clean.withColumn("domain", urls.domain(F.col("clean")))


def url_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages each domain has."""
    clean = read_table(spark, sf_dir, "pages").select(urls.domain(urls.sanitize(F.col("url"))).alias("domain"))
    return clean.groupBy("domain").agg(F.count("*").alias("n"))


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as documents of lines with an image, a link, an anchor and a bare URL;
    every seventh page mentions the skill course, and pages share link targets."""
    page, n = F.col("page_id"), F.col("page_id").cast("string")
    to = lambda k, ext="": F.concat(F.lit("https://www.site"), (page % k).cast("string"), F.lit(f".example/learn{ext}"))
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("- ![pic]("), to(9, ".png"), F.lit(") see [Skill course "), (page % 7).cast("string"), F.lit("]("), to(7, "?id=1&utm_source=feed"), F.lit(")")),
        F.concat(F.lit('1. <a href="'), to(5, "/repo/"), F.lit('">github agent</a> and '), "url"),
        F.concat(F.lit("no links, page "), n),
    )
    return read_table(spark, sf_dir, "pages").select(n.alias("documentId"), F.concat(F.lit("Page "), n).alias("documentTitle"), "url", F.col("url").alias("self"), lines.alias("markdown"), "page_id").withColumn("documentUrl", F.when(page % 2 == 0, F.col("url")).otherwise("https://docs.example/"))


def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of every page: canonical URL, title, domain, category, context."""
    found = links.extract(_inputs(spark, sf_dir))
    return found.select(F.col("documentId").cast("long").alias("page_id"), "id", "url", "title", "domain", "category", "context")


def resource_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each link target: title, category by vote, number of mentions."""
    found = links.extract(_inputs(spark, sf_dir))
    return links.resources(found, [F.col("documentId").cast("long"), F.col("pos")])


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources in every category, also in empty ones."""
    return links.category_counts(links.resources(links.extract(_inputs(spark, sf_dir)), [F.col("documentId").cast("long"), F.col("pos")]))


def resource_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources of a category that mention a text."""
    found, order = links.extract(_inputs(spark, sf_dir)), [F.col("documentId").cast("long"), F.col("pos")]
    return links.matching(links.resources(found, order), links.mentions(found, order), "Skill / 知识库 / 工作流", " COURSE 3").select("id", "url", "title")


def resource_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many domains the link targets have."""
    return links.domain_count(links.resources(links.extract(_inputs(spark, sf_dir)), [F.col("documentId").cast("long"), F.col("pos")]))


def failed_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of pages that a second ingest could not read, one in ten."""
    found = _inputs(spark, sf_dir)
    failed = found.filter(F.col("page_id") % 10 == 2).select(F.col("documentId").alias("id"))
    kept = links.carried(links.mentions(links.extract(found), [F.col("documentId").cast("long"), F.col("pos")]), failed)
    return kept.select(F.col("documentId").cast("long").alias("page_id"), "url", "context")


def node_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of customers as nodes; those of one segment are documents."""
    of = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    nodes = read_table(spark, sf_dir, "customer").select(of("c", "c_custkey").alias("nodeToken"), of("n", "c_nationkey").alias("objToken"), F.when(F.col("c_mktsegment") == "BUILDING", "docx").otherwise("sheet").alias("objType"))
    return sync.tokens_of(sync.documents_of(nodes))


def parent_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers below nations below regions: every node's depth and parent's title."""
    nation, customer = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "customer")
    of = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    region = read_table(spark, sf_dir, "region").select(of("r", "r_regionkey").alias("nodeToken"), F.lit("").alias("parentNodeToken"), F.col("r_name").alias("title"))
    nodes = nation.select(of("n", "n_nationkey").alias("nodeToken"), of("r", "n_regionkey").alias("parentNodeToken"), F.col("n_name").alias("title")).unionByName(
        customer.select(of("c", "c_custkey").alias("nodeToken"), of("n", "c_nationkey").alias("parentNodeToken"), F.col("c_name").alias("title"))
    )
    return sync.with_parent_title(sync.walk(nodes, region), "root").select("nodeToken", "title", "parentTitle", "depth")


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that cite two others, one of them twice, and one that is no report."""
    n, s = F.col("doc_id"), lambda c: c.cast("string")
    cite = lambda to, title, kind: F.concat(F.lit('<cite doc-id="'), s(to), F.lit(f'" title="{title}" file-type="{kind}"></cite> '))
    good, bad = r"R 2024-01-01\~2024-01-07", "R 2024"
    text = F.concat(cite(n * 2 + 1, good, "DOCX"), cite(n * 2 + 2, good, "docx"), cite(n * 2 + 1, good, "docx"), cite(n % 7, good, "docx"), cite(n + 1, bad, "docx"), cite(n + 1, good, "sheet"))
    return read_table(spark, sf_dir, "documents").select(s(n).alias("documentId"), text.alias("markdown"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports that every document cites."""
    found = sync.citations(_cited(spark, sf_dir))
    return found.select(F.col("documentId").cast("long").alias("doc_id"), F.col("docId").cast("long").alias("cited"), "title")


def citation_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that document 0 leads to, over however many steps."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"))
    edges = sync.citations(_cited(spark, sf_dir)).select(F.col("documentId").alias("src"), F.col("docId").alias("dst"))
    found = sync.closure(docs.filter("id = '0'"), edges, allowed=docs)
    return found.select(F.col("id").cast("long").alias("doc_id"), "depth")


def citations_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of documents that do not exist."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"))
    out = sync.refused(sync.citations(_cited(spark, sf_dir)), docs)
    return out.select(F.col("documentId").cast("long").alias("doc_id"), F.col("docId").cast("long").alias("cited"))


def sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second ingest does with every document: of ten, one is new, one
    changed, one could not be read, one is gone, and one lost its chunks."""
    docs, d = read_table(spark, sf_dir, "documents"), F.col("doc_id") % 10
    fetched = docs.filter(d != 3).select(F.col("doc_id").alias("id"), F.when(d == 2, F.lit(None)).when(d == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("markdown"))
    previous = docs.filter(d != 0).select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("contentHash"))
    chunked = docs.filter(~d.isin(0, 4)).select(F.col("doc_id").alias("documentId"))
    return sync.diff(fetched, previous, chunked).select(F.col("id").alias("doc_id"), "change", F.col("contentHash").alias("content_hash"))


def embedding_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have no vector yet."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    done = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return sync.pending(docs, done).select(F.col("id").alias("doc_id"), "source")


def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of documents, chunks and vectors, and the status."""
    docs = read_table(spark, sf_dir, "documents")
    held = docs.join(read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    return sync.state(docs, held, []).select("status", "documentCount", "chunkCount", "embeddedChunkCount")


def resources_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets in their order: by category, then by title with numbers in order."""
    found = links.resources(links.extract(_inputs(spark, sf_dir)), [F.col("documentId").cast("long"), F.col("pos")])
    return links.placed(found).select("place", "url", "title", "category")


def documents_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the order of a list of documents: by name from the last to the first."""
    part = read_table(spark, sf_dir, "part").select(F.col("p_name").alias("title"), F.col("p_partkey").alias("doc_pos"))
    return sync.placed(part).select("place", F.col("doc_pos").alias("p_partkey"), "title")


def _fetched(spark: SparkSession, sf_dir: str, day: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, fetched) of two days: documents under their sources; every fiftieth cites a
    document outside the tree, half of which are allowed. On day 2 some are new,
    others changed, gone, or could not be read."""
    docs, d = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), F.col("doc_id")
    here = docs.filter((d % 10 != 3) if day == 1 else (d % 13 != 0))
    n = d.cast("string")
    nodes = here.select(F.concat(F.lit("n"), n).alias("nodeToken"), F.concat(F.lit("o"), n).alias("objToken"), F.lit("docx").alias("objType"), F.concat(F.lit("s-"), "source").alias("parentNodeToken"), F.concat(F.lit("Document "), n).alias("title"))
    folders = here.select("source").distinct().select(F.concat(F.lit("s-"), "source").alias("nodeToken"), F.concat(F.lit("o-"), "source").alias("objToken"), F.lit("folder").alias("objType"), F.lit("root").alias("parentNodeToken"), F.col("source").alias("title"))
    root = spark.createDataFrame([("root", "root", "wiki", "", "Root")], "nodeToken string, objToken string, objType string, parentNodeToken string, title string")
    cite = F.concat(F.lit('\n<cite doc-id="x'), n, F.lit('" title="Report 2024-01-01~2024-01-07" file-type="docx"></cite>'))
    text = F.concat("text", F.when(d % 50 == 1, cite).otherwise(""), F.when((d % 7 == 0) & F.lit(day == 2), "\nmore").otherwise(""))
    text = F.when((d % 11 != 0) | F.lit(day == 1), text)
    own = here.select(F.concat(F.lit("n"), n).alias("nodeToken"), F.lit(day).cast("long").alias("revisionId"), text.alias("markdown"), d.alias("doc_pos"))
    beyond = here.filter(d % 50 == 1).select(F.concat(F.lit("x"), n).alias("nodeToken"), F.lit(day).cast("long").alias("revisionId"), F.concat(F.lit("cited "), n).alias("markdown"), (d + 10_000_000).alias("doc_pos"))
    return root.unionByName(folders).unionByName(nodes), own.unionByName(beyond)


def two_ingests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after two ingests in a row, with the day that each was read, and the
    ingest that wrote its chunks."""
    path = f"{shared_dir(spark)}/siltstone/ingest-{uuid.uuid4().hex}"
    allowed = read_table(spark, sf_dir, "documents").filter("doc_id % 100 = 1").select(F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias("id"))
    index = None
    for day in (1, 2):
        nodes, fetched = _fetched(spark, sf_dir, day)
        documents, warnings = ingest.wanted(nodes, nodes.filter("nodeToken = 'root'"), fetched, allowed, "https://base.example", "Source")
        index = ingest.ingest(spark, path, documents, warnings, f"day {day}")
    held = index.chunks.groupBy(F.col("documentId").alias("id")).agg(F.count("*").cast("int").alias("held"))
    told = index.documents.join(held, "id", "left")
    return told.select("id", "parentTitle", "revisionId", "contentHash", F.col("syncedAt").alias("synced_at"), "generation", (F.coalesce("held", F.lit(0)) == F.col("chunkCount")).alias("whole"))


QUERIES = {f.__name__: f for f in (resources_listed, documents_listed, two_ingests, url_sanitize, url_domains, link_extract, resource_merge, category_counts, resource_filter, resource_domains, failed_mentions, node_tokens, parent_titles, citations, citation_closure, citations_refused, sync_diff, embedding_pending, index_status)}

_URL = r"""regexp_extract({0}, '^(https?)://', 1) || '://' || lower(regexp_extract({0}, '^https?://([^/?#]*)', 1)) ||
CASE WHEN regexp_replace(regexp_extract({0}, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract({0}, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') END ||
CASE WHEN {1} = '' THEN '' ELSE '?' || {1} END"""
_KEPT = r"""array_to_string(list_filter(string_split(regexp_extract({0}, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|token|from|scene|key|code|auth)(=|$)')), '&')"""
_CATS = ", ".join(f"('{c}', {i})" for i, c in enumerate(urls.CATEGORIES))
_LINKS = f"""WITH g AS (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://docs.example/' END AS own FROM pages),
s AS (SELECT page_id, own, url, {_URL.format("url", _KEPT.format("url"))} AS bare FROM g),
f AS (
  SELECT page_id, 0 AS line, 0 AS kind, 'https://www.site' || (page_id % 7) || '.example/learn?id=1' AS url, 'Skill course ' || (page_id % 7) AS title, 'site' || (page_id % 7) || '.example' AS domain, 'pic see Skill course ' || (page_id % 7) AS context, 'Skill / 知识库 / 工作流' AS category FROM g
  UNION ALL SELECT page_id, 1, 1, 'https://www.site' || (page_id % 5) || '.example/learn/repo', 'github agent', 'site' || (page_id % 5) || '.example', 'github agent and', 'AI编程与智能体' FROM g
  UNION ALL SELECT page_id, 1, 2, bare, 'github agent and', regexp_replace(regexp_extract(bare, '^https?://([^/?#]*)', 1), '^www\\.', ''), 'github agent and', 'AI编程与智能体' FROM s WHERE page_id % 2 = 1),
r AS (SELECT *, substr(sha1(url), 1, 16) AS id FROM f),
m AS (SELECT url, any_value(id) AS id, arg_min(title, page_id * 10 + line * 3 + kind) AS title, any_value(domain) AS domain, any_value(category) AS category, count(*) AS n_mentions, min(page_id)::VARCHAR AS first_document FROM r GROUP BY url)
"""
_CITED = """WITH c AS (SELECT doc_id, unnest([2 * doc_id + 1, 2 * doc_id + 2, doc_id % 7]) AS cited FROM documents),
u AS (SELECT DISTINCT doc_id, cited FROM c)
"""
ORACLE_SQL = {
    "url_sanitize": f"""WITH a AS (SELECT page_id, regexp_replace(url || CASE WHEN contains(url, '?') THEN '&token=1&x=2)' ELSE '?utm_x=1&a=b)' END, '\\)+$', '') AS u FROM pages),
b AS (SELECT page_id, {_URL.format("u", _KEPT.format("u"))} AS clean FROM a)
SELECT page_id, clean, regexp_replace(regexp_extract(clean, '^https?://([^/?#]*)', 1), '^www\\.', '') AS domain FROM b""",
    "url_domains": r"SELECT regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\.', '') AS domain, count(*) AS n FROM pages GROUP BY 1",
    "link_extract": f"{_LINKS} SELECT page_id, id, url, title, domain, category, context FROM r",
    "resource_merge": f"{_LINKS} SELECT id, url, title, domain, category, n_mentions, first_document FROM m",
    "category_counts": f"{_LINKS}, d(category, ord) AS (VALUES {_CATS}) SELECT d.category, d.ord, count(m.url) AS n FROM d LEFT JOIN m USING (category) GROUP BY ALL",
    "resource_filter": f"{_LINKS} SELECT id, url, title FROM m WHERE category = 'Skill / 知识库 / 工作流' AND title = 'Skill course 3'",
    "resource_domains": f"{_LINKS} SELECT count(DISTINCT domain) AS n_domains FROM m",
    "failed_mentions": f"{_LINKS} SELECT DISTINCT page_id, url, context FROM r WHERE page_id % 10 = 2",
    "node_tokens": "SELECT 'c' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT 'n' || c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING'",
    "parent_titles": """WITH RECURSIVE n AS (SELECT 'n' || n_nationkey AS nodeToken, 'r' || n_regionkey AS p, n_name AS title FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer),
w AS (SELECT 'r' || r_regionkey AS nodeToken, r_name AS title, 'root' AS parentTitle, 0 AS depth FROM region
  UNION ALL SELECT n.nodeToken, n.title, w.title, w.depth + 1 FROM w JOIN n ON n.p = w.nodeToken)
SELECT * FROM w""",
    "citations": f"{_CITED} SELECT doc_id, cited, 'R 2024-01-01~2024-01-07' AS title FROM u",
    "citation_closure": """WITH RECURSIVE e AS (SELECT DISTINCT doc_id AS src, unnest([2 * doc_id + 1, 2 * doc_id + 2, doc_id % 7]) AS dst FROM documents),
r AS (SELECT 0::BIGINT AS doc_id, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.doc_id JOIN documents d ON d.doc_id = e.dst WHERE r.depth < 40)
SELECT doc_id, min(depth)::INTEGER AS depth FROM r GROUP BY doc_id""",
    "citations_refused": f"{_CITED} SELECT u.doc_id, cited FROM u WHERE cited NOT IN (SELECT doc_id FROM documents)",
    "sync_diff": """SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'new' WHEN 1 THEN 'changed' WHEN 2 THEN 'kept' WHEN 3 THEN 'dropped' WHEN 4 THEN 'changed' ELSE 'unchanged' END AS change,
sha256(CASE WHEN doc_id % 10 = 1 THEN text || '!' ELSE text END) AS content_hash FROM documents""",
    "embedding_pending": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "index_status": "SELECT 'ready' AS status, count(*) AS documentCount, count(*) AS chunkCount, count(embedding) AS embeddedChunkCount FROM documents LEFT JOIN embeddings ON vec_id = doc_id",
    "resources_listed": f"""{_LINKS}, d(category, ord) AS (VALUES {_CATS}), o AS (SELECT url, title, category, ord, title || '' AS t FROM m LEFT JOIN d USING (category))
SELECT row_number() OVER (ORDER BY ord, regexp_replace(lower(t), '([0-9]+)$', ''), try_cast(regexp_extract(t, '([0-9]+)$', 1) AS BIGINT) NULLS FIRST, url) AS place, url, title, category FROM o""",
    "documents_listed": "SELECT row_number() OVER (ORDER BY p_name DESC, p_partkey) AS place, p_partkey, p_name AS title FROM part",
    "two_ingests": """WITH d AS (SELECT *, doc_id % 10 <> 3 AS here1, doc_id % 13 <> 0 AS here2, doc_id % 11 = 0 AS failed, doc_id % 50 = 1 AS cites, doc_id % 100 = 1 AS allowed,
  text || CASE WHEN doc_id % 50 = 1 THEN chr(10) || '<cite doc-id="x' || doc_id || '" title="Report 2024-01-01~2024-01-07" file-type="docx"></cite>' ELSE '' END AS m1 FROM documents),
e AS (SELECT *, m1 || CASE WHEN doc_id % 7 = 0 THEN chr(10) || 'more' ELSE '' END AS m2, m1 IS NULL OR failed AS no2 FROM d)
SELECT 'n' || doc_id AS id, source AS parentTitle, CASE WHEN no2 THEN 1 ELSE 2 END::BIGINT AS revisionId, sha256(CASE WHEN no2 THEN m1 ELSE m2 END) AS contentHash,
  CASE WHEN no2 THEN 'day 1' ELSE 'day 2' END AS synced_at, CASE WHEN no2 OR (here1 AND doc_id % 7 <> 0) THEN 1 ELSE 2 END::BIGINT AS generation, TRUE AS whole
FROM e WHERE here2 AND (NOT no2 OR here1) AND m1 IS NOT NULL
UNION ALL SELECT 'x' || doc_id, 'Document ' || doc_id, 2, sha256('cited ' || doc_id), 'day 2', CASE WHEN here1 THEN 1 ELSE 2 END, TRUE FROM e WHERE here2 AND cites AND allowed AND NOT no2""",
}
