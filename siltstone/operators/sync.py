"""Incremental ingest: tree walk, citation closure, change detection, embeddings to do."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.dates import RANGE
from siltstone.functions.text import trim
from siltstone.shared import numbered, store


def walk(nodes: DataFrame, root: DataFrame, depth: int | None = None) -> DataFrame:
    """All nodes below the root rows, each once, with their depth: one join for each
    level, so cycles end. A tree deeper than ``depth``, if given, raises an error.

    nodes: nodeToken, parentNodeToken and others; root: the same columns.
    """
    level = store(root.withColumn("depth", F.lit(0)), "level")
    out = level
    for d in count(1):
        above = level.select(F.col("nodeToken").alias("parentNodeToken"))
        below = nodes.join(above, "parentNodeToken").select(*nodes.columns).join(out.select("nodeToken"), "nodeToken", "left_anti").select(*nodes.columns)
        level = store(below.dropDuplicates(["nodeToken"]).withColumn("depth", F.lit(d)), "level")
        if level.isEmpty():
            return out
        if d == depth:
            raise ValueError(f"the tree has more than {depth} levels")
        # written anew, so that the plan does not grow with the levels
        out = store(out.unionByName(level), "walked")


def documents_of(nodes: DataFrame) -> DataFrame:
    """Nodes that are text documents."""
    return nodes.filter(F.col("objType") == "docx")


def tokens_of(nodes: DataFrame) -> DataFrame:
    """(id) the node and object tokens of nodes, each once."""
    return nodes.select(F.col("nodeToken").alias("id")).union(nodes.select("objToken")).distinct()


def listed(documents: DataFrame) -> DataFrame:
    """Documents by title from the last to the first, as Chinese sorts them."""
    return documents.orderBy(F.collate("title", "zh").desc(), "doc_pos")


def placed(documents: DataFrame) -> DataFrame:
    """``listed`` with each document's place in the list, from one up."""
    return numbered(documents, [F.collate("title", "zh").desc(), F.col("doc_pos")])


def with_parent_title(nodes: DataFrame, default: str, titles: DataFrame | None = None) -> DataFrame:
    """Nodes with their parent's title; titles: where parents are, if not among the nodes."""
    parents = (nodes if titles is None else titles).select(F.col("nodeToken").alias("parentNodeToken"), F.col("title").alias("parentTitle"))
    return nodes.join(parents, "parentNodeToken", "left").withColumn("parentTitle", F.coalesce("parentTitle", F.lit(default)))


def attributes(tag: Column) -> Column:
    """map of name="value" pairs; of a repeated name the last counts."""
    pattern = F.lit(r'([\w-]+)\s*=\s*"([^"]*)"')
    names, values = (F.regexp_extract_all(tag, pattern, F.lit(i)) for i in (1, 2))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.greatest(F.size(names), F.lit(1))), p["k"]))
    return F.map_from_entries(last)


def citations(docs: DataFrame) -> DataFrame:
    """(documentId, pos, docId, title) of the reports that a document cites, each once."""
    tags = docs.select("documentId", F.posexplode(F.regexp_extract_all("markdown", F.lit(r"<cite\b([^>]*)>"), F.lit(1))).alias("pos", "tag"))
    told = tags.withColumn("a", attributes(F.col("tag"))).select("documentId", "pos", trim(F.try_element_at("a", F.lit("doc-id"))).alias("docId"), trim(F.regexp_replace(F.try_element_at("a", F.lit("title")), r"\\~", "~")).alias("title"), F.lower(F.try_element_at("a", F.lit("file-type"))).alias("type"))
    good = told.filter((F.col("docId") != "") & (F.col("type") == "docx") & F.col("title").rlike(RANGE))
    return good.groupBy("documentId", "docId").agg(F.min(F.struct("pos", "title")).alias("f")).select("documentId", "f.pos", "docId", "f.title")


def closure(start: DataFrame, edges: DataFrame, allowed: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """(id, depth) of all that is reached from ``start`` (id) along edges (src, dst):
    level by level, each only with what was not seen before, so cycles end. Only
    ids in ``allowed`` are entered. More than ``depth`` levels, if given, raise an error."""
    seen = store(start.select("id").distinct().withColumn("depth", F.lit(0)), "seen")
    front = seen
    for d in count(1):
        reached = edges.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        if allowed is not None:
            reached = reached.join(allowed.select("id"), "id", "left_semi")
        front = store(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)), "front")
        if front.isEmpty():
            return seen
        if d == depth:
            raise ValueError(f"citations lead on for more than {depth} levels")
        seen = store(seen.unionByName(front), "seen")


def refused(cited: DataFrame, allowed: DataFrame) -> DataFrame:
    """Citations of ids that are neither in the tree nor on the allowlist."""
    return cited.join(allowed.select(F.col("id").alias("docId")), "docId", "left_anti")


def allowlist(said: Column) -> Column:
    """The distinct entries of a comma-separated list."""
    return F.array_distinct(F.filter(F.transform(F.split(said, ","), trim), lambda x: x != ""))


def diff(fetched: DataFrame, previous: DataFrame, chunked: DataFrame) -> DataFrame:
    """What is to be done with each document.

    fetched: id, markdown (null if the fetch failed); previous: id, contentHash;
    chunked: documentId of the chunks there are. change is new, changed,
    unchanged, kept (failed, but known), or dropped (no longer there); documents
    that failed and are not known do not appear.
    """
    held = chunked.select(F.col("documentId").alias("id")).distinct().withColumn("hasChunks", F.lit(True))
    both = fetched.select("id", F.sha2("markdown", 256).alias("newHash"), F.lit(True).alias("fetched")).join(previous.select("id", F.col("contentHash").alias("oldHash"), F.lit(True).alias("known")), "id", "full").join(held, "id", "left")
    change = (
        F.when(F.col("fetched").isNull(), "dropped")
        .when(F.col("newHash").isNull(), F.when(F.col("known"), "kept"))
        .when(F.col("known").isNull(), "new")
        .when((F.col("newHash") == F.col("oldHash")) & F.coalesce("hasChunks", F.lit(False)), "unchanged")
        .otherwise("changed")
    )
    return both.select("id", change.alias("change"), F.coalesce("newHash", "oldHash").alias("contentHash")).filter("change is not null")


def next_chunks(changes: DataFrame, old: DataFrame, new: DataFrame, provider_changed: bool) -> DataFrame:
    """Chunks of the next snapshot: old ones where nothing changed (without vectors
    if the provider did), new ones elsewhere."""
    keep = changes.filter(F.col("change").isin("unchanged", "kept"))
    reused = old.join(keep.select(F.col("id").alias("documentId"), "change"), "documentId")
    if provider_changed:
        reused = reused.withColumn("embedding", F.when(F.col("change") == "kept", F.col("embedding")))
    made = new.join(changes.filter(F.col("change").isin("new", "changed")).select(F.col("id").alias("documentId")), "documentId", "left_semi")
    return reused.select(*old.columns).unionByName(made, allowMissingColumns=True)


def state(documents: DataFrame, chunks: DataFrame, warnings: list[str]) -> DataFrame:
    """One row of counts and the status."""
    told = chunks.agg(F.count("*").alias("chunkCount"), F.count_if(F.size("embedding") > 0).alias("embeddedChunkCount")).withColumn("k", F.lit(1))
    one = documents.agg(F.count("*").alias("documentCount")).withColumn("k", F.lit(1)).join(told, "k").drop("k")
    return one.withColumns({"status": F.lit("partial" if warnings else "ready"), "warnings": F.array(*map(F.lit, warnings)).cast("array<string>")})


def pending(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks whose id the checkpoint does not have."""
    return chunks.join(done.select("id"), "id", "left_anti")


def no_vector() -> Column:
    return F.lit(None).cast("array<float>")


def can_use_query_vectors(state: DataFrame, provider: str | None, disabled: bool = False, local_on_hosted: bool = False) -> DataFrame:
    """One row, usable: whether a question's vector may be compared with the index of
    ``state``, whose vectors must be there and of the same model. A model that runs
    locally is not loaded on a hosted runtime."""
    allowed = F.lit(bool(provider) and not disabled and not local_on_hosted)
    same = F.coalesce(F.col("embeddingProvider") == F.lit(provider), F.lit(False))
    return state.agg(F.coalesce(F.max(allowed & same & (F.coalesce("embeddedChunkCount", F.lit(0)) > 0)), F.lit(False)).alias("usable"))


def embed(chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch: int = 16, text_col: str = "contextualText", purpose: str = "document") -> DataFrame:
    """(id, embedding): texts go to ``embedder`` in batches; the vector comes back in
    the row of its text, so nothing is matched by position across tasks. Models tell
    questions from documents by a prefix; for questions purpose is "query"."""
    import pandas as pd

    prefix = "query: " if purpose == "query" else "passage: "

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                some = frame.iloc[i : i + batch]
                yield pd.DataFrame({"id": some["id"], "embedding": embedder([prefix + (t or "") for t in some[text_col]])})

    return chunks.select("id", text_col).mapInPandas(run, "id string, embedding array<float>")


def resumed(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks with the checkpoint's vectors where it has them."""
    return chunks.join(done.select("id", F.col("embedding").alias("made")), "id", "left").withColumn("embedding", F.coalesce("made", "embedding")).drop("made")
