"""One ingest from the tree of nodes to the stored index, writing only what changed.

A folder holds, for each ingest that wrote something, a generation of chunks and of
link mentions: those of its new and changed documents. The documents of an ingest
are one row each and name the generation that holds their chunks, so an unchanged
document costs one row, and a dropped one nothing. Everything is written under the
number of the ingest, the pointer last: an ingest that is stopped in between is
not seen, and a repeated one replaces what it left.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.functions.urls import CATEGORIES
from siltstone.operators import chunking, links, sync
from siltstone.shared import store

DOCUMENTS = "id string, nodeToken string, objToken string, title string, parentTitle string, url string, revisionId long, contentHash string, syncedAt string, chunkCount int, generation long, doc_pos long"
CHUNKS = "id string, documentId string, nodeToken string, title string, parentTitle string, heading string, url string, content string, contextualText string, tokens array<string>, embedding array<float>, ordinal int, generation long"
MENTIONS = "id string, url string, title string, domain string, category string, documentId string, documentTitle string, documentUrl string, context string, line long, kind int, pos int, generation long"
STATE = "number long, status string, startedAt string, documentCount long, chunkCount long, embeddedChunkCount long, resourceCount long, categories map<string,long>, embeddingProvider string, warnings array<string>"


@dataclass
class Index:
    number: int
    documents: DataFrame
    chunks: DataFrame
    mentions: DataFrame
    state: DataFrame


def _table(spark: SparkSession, path: str, schema: str, upto: int | None = None) -> DataFrame:
    """A stored table, empty if it is not there; upto: of ingests up to that number."""
    names = StructType.fromDDL(schema).fieldNames()
    try:
        rows = spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise
    return (rows if upto is None else rows.filter(F.col("ingest") <= upto)).select(*names)


def _current(spark: SparkSession, path: str, name: str, schema: str, number: int, upto: int) -> DataFrame:
    """The rows of a table's generations up to one that the documents of an ingest name."""
    named = _table(spark, f"{path}/documents/ingest={number}", DOCUMENTS).select(F.col("id").alias("documentId"), "generation")
    return _table(spark, f"{path}/{name}", schema, upto).join(named, ["documentId", "generation"], "left_semi")


def read(spark: SparkSession, path: str) -> Index:
    """The index as the last whole ingest left it; empty if there is none."""
    state = _table(spark, f"{path}/state", STATE)
    number = state.agg(F.max("number")).collect()[0][0] or 0
    documents = _table(spark, f"{path}/documents/ingest={number}", DOCUMENTS)
    chunks, mentions = (_current(spark, path, name, schema, number, number) for name, schema in (("chunks", CHUNKS), ("mentions", MENTIONS)))
    return Index(number, documents, chunks, mentions, state.filter(F.col("number") == number))


def cited(fetched: DataFrame, trees: DataFrame, allowed: DataFrame) -> DataFrame:
    """Nodes that documents of the tree cite, and that those cite: token, title and the
    document that names them first. fetched: nodeToken, markdown, doc_pos."""
    edges = store(sync.citations(fetched.filter("markdown is not null").select(F.col("nodeToken").alias("documentId"), "markdown")), "ingest-citations")
    seen = sync.tokens_of(trees)
    reached = sync.closure(seen, edges.select(F.col("documentId").alias("src"), F.col("docId").alias("dst")), allowed)
    depth = reached.select(F.col("id").alias("documentId"), "depth")
    order = fetched.select(F.col("nodeToken").alias("documentId"), "doc_pos")
    naming = edges.join(depth, "documentId").join(order, "documentId").groupBy("docId").agg(F.min(F.struct("depth", "doc_pos", "pos", "documentId", "title")).alias("f"))
    new = reached.filter("depth > 0").select(F.col("id").alias("docId"))
    return naming.join(new, "docId").select(F.col("docId").alias("nodeToken"), F.col("docId").alias("objToken"), F.col("f.documentId").alias("parentNodeToken"), F.col("f.title").alias("title"))


def wanted(nodes: DataFrame, root: DataFrame, fetched: DataFrame, allowlist: DataFrame, base_url: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(documents, warnings): the documents of the tree and those cited, each with what
    was fetched (markdown is null where that failed), and what is to be told.
    allowlist: ids (id) of documents outside the tree that may be cited."""
    every = store(sync.walk(nodes, root).drop("depth"), "ingest-nodes")
    trees = sync.documents_of(every)
    got = fetched.select("nodeToken", "revisionId", "markdown", "doc_pos")
    own = sync.tokens_of(every)
    allowed = own.unionByName(allowlist.select("id"))
    more = cited(got, trees, allowed)
    titled = sync.with_parent_title(trees, name, every).select("nodeToken", "objToken", "title", "parentTitle", F.concat(F.lit(f"{base_url}/wiki/"), "nodeToken").alias("url"))
    titles = trees.select("nodeToken", "title").unionByName(more.select("nodeToken", "title"))
    beyond = sync.with_parent_title(more, name, titles).select("nodeToken", "objToken", "title", "parentTitle", F.concat(F.lit(f"{base_url}/docx/"), "nodeToken").alias("url"))
    documents = store(titled.unionByName(beyond).join(got, "nodeToken", "left"), "ingest-wanted")
    cites = sync.citations(documents.filter("markdown is not null").select(F.col("nodeToken").alias("documentId"), "markdown"))
    warnings = documents.filter("markdown is null").select(F.concat("title", F.lit(": fetch failed")).alias("warning"))
    return documents, warnings.unionByName(sync.refused(cites, allowed).select(F.concat(F.lit("已忽略未授权的外部引用："), "title").alias("warning")))


def ingest(spark: SparkSession, path: str, documents: DataFrame, warnings: DataFrame, now: str, provider: str | None = None, embedder: Callable[[list[str]], list[list[float]]] | None = None, rebuild: bool = False, most_warnings: int = 1_000) -> Index:
    """Writes the next state of the index at ``path`` from ``wanted`` documents.

    Documents are new, changed, unchanged (chunks stay, even under an old title), bare
    (unchanged, of a text that makes no chunks), kept (their fetch failed) or dropped. If the model is another than before, the chunks
    of unchanged documents get new vectors. Of the warnings at most ``most_warnings``
    are stored as text; any makes the status "partial".
    """
    before = read(spark, path)
    number = before.number + 1
    row = before.state.select("embeddingProvider").collect()
    other_model = bool(row and row[0][0]) and row[0][0] != provider
    changes = sync.diff(documents.select(F.col("nodeToken").alias("id"), "markdown"), before.documents.select("id", "contentHash"), before.chunks.select("documentId"))
    # a text that made no chunks has none to be made anew: it stays in its generation
    bare = before.documents.filter("chunkCount = 0").select("id", "contentHash", F.lit(True).alias("bare"))
    changes = changes.join(bare, ["id", "contentHash"], "left").withColumn("change", F.when((F.col("change") == "changed") & F.col("bare"), "bare").otherwise(F.col("change"))).drop("bare")
    if rebuild:
        changes = changes.withColumn("change", F.when(F.col("change").isin("unchanged", "bare"), "changed").otherwise(F.col("change")))
    changes = store(changes, "ingest-changes")
    fresh = documents.join(changes.filter("change in ('new', 'changed')").select(F.col("id").alias("nodeToken")), "nodeToken", "left_semi")
    made = chunking.chunk_documents(fresh.select(F.col("nodeToken").alias("documentId"), "nodeToken", "title", "parentTitle", "url", "markdown")).withColumn("embedding", sync.no_vector())
    if other_model:  # old chunks move to this generation, with new vectors
        same = changes.filter("change = 'unchanged'").select(F.col("id").alias("documentId"))
        made = made.unionByName(before.chunks.drop("generation").join(same, "documentId", "left_semi").withColumn("embedding", sync.no_vector()))
    made = store(made, "ingest-chunks")
    if embedder is not None:
        made = made.drop("embedding").join(sync.embed(made, embedder), "id")
    # what is written is counted while it is written
    counted = Observation()
    written = made.withColumn("generation", F.lit(number).cast("long")).observe(counted, F.count("*").alias("chunks"), F.count_if(F.size("embedding") > 0).alias("embedded"))
    written.select(*spark.createDataFrame([], CHUNKS).columns).write.mode("overwrite").parquet(f"{path}/chunks/ingest={number}")
    # links are taken from all that was fetched anew; those of others stay in their generation
    found = links.extract(fresh.select(F.col("nodeToken").alias("documentId"), F.col("title").alias("documentTitle"), F.col("url").alias("documentUrl"), "markdown"))
    moved = before.mentions.join(changes.filter("change in ('unchanged', 'bare')").select(F.col("id").alias("documentId")), "documentId", "left_semi") if other_model else before.mentions.limit(0)
    found = found.withColumns({"line": F.col("pos.line_no").cast("long"), "kind": F.col("pos.kind"), "pos": F.col("pos.pos")})
    mentions = found.unionByName(moved.drop("generation")).withColumn("generation", F.lit(number).cast("long"))
    columns = spark.createDataFrame([], MENTIONS).columns
    mentions.select(*columns).write.mode("overwrite").parquet(f"{path}/mentions/ingest={number}")
    counts = made.groupBy(F.col("documentId").alias("id")).agg(F.count("*").cast("int").alias("made"))
    old = before.documents.select("id", *(F.col(c).alias(f"old_{c}") for c in ("objToken", "title", "parentTitle", "url", "revisionId", "syncedAt", "chunkCount", "generation", "doc_pos")))
    told = changes.filter("change != 'dropped'").join(documents.withColumnRenamed("nodeToken", "id"), "id").join(old, "id", "left").join(counts, "id", "left")
    anew, kept = F.col("change").isin("new", "changed"), F.col("change") == "kept"
    pick = lambda c: F.when(anew | (F.col("change") == "bare"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c)
    generation = F.when(anew | (~kept & F.lit(other_model)), F.lit(number).cast("long")).otherwise(F.col("old_generation"))
    rows = told.select(
        "id", F.col("id").alias("nodeToken"), pick("objToken"), pick("title"), pick("parentTitle"), pick("url"), F.when(kept, F.col("old_revisionId")).otherwise(F.col("revisionId")).alias("revisionId"), "contentHash",
        F.when(kept, F.col("old_syncedAt")).otherwise(F.lit(now)).alias("syncedAt"), F.when(anew, F.coalesce("made", F.lit(0))).otherwise(F.col("old_chunkCount")).alias("chunkCount"), generation.alias("generation"), F.coalesce("doc_pos", "old_doc_pos").alias("doc_pos"),
    )
    whole = Observation()
    rows.observe(whole, F.count("*").alias("documents"), F.sum("chunkCount").alias("chunks")).write.mode("overwrite").parquet(f"{path}/documents/ingest={number}")
    seen = whole.get
    named = _current(spark, path, "mentions", MENTIONS, number, number)
    resources = links.resources(named, [F.col("documentId"), F.col("line"), F.col("kind"), F.col("pos")])
    by_category = {r[0]: r[1] for r in resources.groupBy("category").count().collect()}  # a row for each category
    reused = _current(spark, path, "chunks", CHUNKS, number, number - 1)
    embedded = counted.get["embedded"] + (reused.filter(F.size("embedding") > 0).count() if provider else 0)
    said = [r[0] for r in warnings.limit(most_warnings).collect()]
    categories = {c: by_category.get(c, 0) for c in CATEGORIES}
    state = [(number, "partial" if said else "ready", now, seen["documents"], seen["chunks"] or 0, embedded, sum(by_category.values()), categories, provider if embedded else None, said)]
    spark.createDataFrame(state, STATE).coalesce(1).write.mode("append").parquet(f"{path}/state")
    return read(spark, path)


def status(index: Index) -> DataFrame:
    """One row of counts, from what was counted while the index was written."""
    return index.state.select("status", F.col("startedAt").alias("completed_at"), F.col("documentCount").alias("documents"), F.col("chunkCount").alias("chunks"), F.col("embeddedChunkCount").alias("embedded_chunks"), F.col("resourceCount").alias("resources"))


def report(index: Index) -> DataFrame:
    """One JSON line: status, totals, resources by category with zeros, warnings."""
    return index.state.select(F.to_json(F.struct("status", F.col("documentCount").alias("documents"), F.col("chunkCount").alias("chunks"), F.col("embeddedChunkCount").alias("embeddedChunks"), F.col("resourceCount").alias("resources"), F.col("categories").alias("resourceCategories"), "warnings")).alias("line"))
