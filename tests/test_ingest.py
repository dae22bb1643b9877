"""Ingests in a row, ingests that stop, and embeddings that are made once."""

import duckdb
import pytest
from pyspark.sql import functions as F

from siltstone.operators import ingest, sync
from siltstone.plans import link_queries
from siltstone.sources import progress

NODES = "nodeToken string, objToken string, objType string, parentNodeToken string, title string"
FETCHED = "nodeToken string, revisionId long, markdown string, doc_pos long"
CITE = '<cite doc-id="{}" title="R 2026-01-01~2026-01-07" file-type="docx"></cite>'


def wanted(spark, texts, allow=("x",)):
    nodes = spark.createDataFrame([("root", "r", "wiki", "", "Root")] + [(k, f"o{k}", "docx", "root", f"Title {k}") for k in texts if k not in ("x", "y", "z")], NODES)
    fetched = spark.createDataFrame([(k, 1, t, n) for n, (k, t) in enumerate(texts.items())], FETCHED)
    return ingest.wanted(nodes, nodes.filter("nodeToken = 'root'"), fetched, spark.createDataFrame([(a,) for a in allow], "id string"), "https://base", "Source")


def told(index):
    return {r["id"]: (r["syncedAt"], r["chunkCount"], r["generation"]) for r in index.documents.collect()}


def vectors(texts):
    return [[float(len(t)), 1.0] for t in texts]


DAY1 = {"a": "alpha https://e.org/p", "b": "beta " + CITE.format("x"), "c": "gamma", "d": "delta " + CITE.format("no"), "x": "cited " + CITE.format("y") + CITE.format("oa"), "y": "not allowed"}
DAY2 = {"a": "alpha https://e.org/p", "b": "beta now https://e.org/q " + CITE.format("x"), "c": None, "e": "new", "f": None, "x": "cited"}


def test_two_ingests(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    documents, warnings = wanted(spark, DAY1)
    assert {(r["nodeToken"], r["parentTitle"], r["url"]) for r in documents.collect()} == {(k, "Root", f"https://base/wiki/{k}") for k in "abcd"} | {("x", "Title b", "https://base/docx/x")}
    one = ingest.ingest(spark, path, documents, warnings, "t1", "m", vectors)
    assert told(one) == {k: ("t1", 1, 1) for k in "abcdx"}
    state = one.state.collect()[0]
    assert state["status"] == "partial" and sorted(state["warnings"]) == ["已忽略未授权的外部引用：R 2026-01-01~2026-01-07"] * 2
    assert (state["documentCount"], state["chunkCount"], state["embeddedChunkCount"], state["resourceCount"]) == (5, 5, 5, 1)
    two = ingest.ingest(spark, path, *wanted(spark, DAY2), "t2", "m", vectors)
    # a is as it was, b and x changed, c could not be read, d is gone, f never was there
    assert told(two) == {"a": ("t2", 1, 1), "b": ("t2", 1, 2), "c": ("t1", 1, 1), "e": ("t2", 1, 2), "x": ("t2", 1, 2)}
    assert {r["documentId"] for r in two.chunks.collect()} == set("abcex")
    assert spark.read.parquet(f"{path}/chunks/ingest=2").count() == 3
    state = ingest.status(two).collect()[0].asDict()
    assert state == {"status": "partial", "completed_at": "t2", "documents": 5, "chunks": 5, "embedded_chunks": 5, "resources": 2}
    assert '"documents":5' in ingest.report(two).collect()[0]["line"] and '"硬件与产品":0' in ingest.report(two).collect()[0]["line"]
    three = ingest.ingest(spark, path, *wanted(spark, {k: v for k, v in DAY2.items() if v}), "t3", "other", vectors)
    assert three.state.collect()[0]["status"] == "ready"
    assert {r["generation"] for r in three.documents.collect()} == {3} and three.state.collect()[0]["embeddedChunkCount"] == 4
    assert three.mentions.count() == 2


def test_an_ingest_that_stops_is_not_seen_and_can_be_repeated(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/i"
    ingest.ingest(spark, path, *wanted(spark, DAY1), "t1")
    before = {r["id"] for r in ingest.read(spark, path).documents.collect()}

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(ingest.links, "resources", stop)  # chunks, mentions and documents are written by then
        with pytest.raises(RuntimeError):
            ingest.ingest(spark, path, *wanted(spark, DAY2), "t2")
    seen = ingest.read(spark, path)
    assert seen.number == 1 and {r["id"] for r in seen.documents.collect()} == before and seen.chunks.count() == 5
    two = ingest.ingest(spark, path, *wanted(spark, DAY2), "t3")
    assert told(two)["b"] == ("t3", 1, 2) and two.chunks.count() == 5


def test_embeddings_are_made_once_by_a_job_that_stops(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    rows = spark.createDataFrame([(f"c{n}", f"text {n}", [9.0]) for n in range(40)], "id string, contextualText string, embedding array<float>")

    def failing(texts):
        if any(t.endswith((" 7", " 31")) for t in texts):
            raise RuntimeError("no more")
        return [[float(len(t))] for t in texts]

    with pytest.raises(Exception, match="no more"):
        progress.reembed(rows, path, "m", "t", failing, batch=2, part_rows=5).collect()
    state = ("m", "t", 40)
    first = {r["id"] for r in progress.progress(spark, path, *state).collect()}
    assert 0 < len(first) < 40 and not first & {"c7", "c31"}
    assert progress.progress(spark, path, "other", "t", 40).count() == 0  # another model, another state
    asked = spark.sparkContext.accumulator(0)

    def counting(texts):
        asked.add(len(texts))
        return [[float(len(t))] for t in texts]

    made = {r["id"]: r["embedding"] for r in progress.reembed(rows, path, "m", "t", counting, batch=2, part_rows=5).collect()}
    assert asked.value == 40 - len(first) and made == {f"c{n}": [float(len(f"passage: text {n}"))] for n in range(40)}
    lines = [x for f in (tmp_path / "p").glob("part-*") for x in f.read_text().splitlines()[1:]]
    assert len(lines) == 40
    (tmp_path / "p" / "part-broken.jsonl").write_text('{"type": "hea')
    assert progress.progress(spark, path, *state).count() == 40
    assert progress.progress(spark, f"file://{tmp_path}/none", *state).count() == 0


def test_when_query_vectors_may_be_used(spark):
    state = lambda provider, n: spark.createDataFrame([(provider, n)], "embeddingProvider string, embeddedChunkCount long")
    usable = lambda df, *a, **k: sync.can_use_query_vectors(df, *a, **k).collect()[0]["usable"]
    assert usable(state("m", 3), "m")
    assert not any((usable(state("m", 0), "m"), usable(state("n", 3), "m"), usable(state(None, 3), "m"), usable(state("m", 3), None), usable(state("m", 3), "m", disabled=True), usable(state("m", 3), "m", local_on_hosted=True), usable(state("m", 3).limit(0), "m")))


def test_prefixes_tell_questions_from_documents(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None)], "id string, contextualText string")
    seen = lambda **k: {r["id"]: r["embedding"] for r in sync.embed(df, lambda texts: [[float(len(t))] for t in texts], **k).collect()}
    assert seen() == {"a": [10.0], "b": [9.0]} and seen(purpose="query") == {"a": [8.0], "b": [7.0]}


def test_texts_without_chunks_stay_in_their_generation(spark, tmp_path):
    odd = ["", " \n ", "<br>", "# Title", None, '<a href="https://e.org/p"></a>', "plain"]
    rows = [(n, odd[n % 5] if n % 3 else odd[5 + n % 2], f"src{n % 4}") for n in range(240)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = link_queries.two_ingests(spark, str(tmp_path))
    columns = ", ".join(found.columns)
    want = con.sql(f"SELECT {columns} FROM ({link_queries.ORACLE_SQL['two_ingests']})").fetchall()
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_texts_without_chunks_keep_their_links_and_get_new_titles(spark, tmp_path):
    path, link = f"file://{tmp_path}/i", '<a href="https://e.org/p"></a>'
    one = ingest.ingest(spark, path, *wanted(spark, {"a": link, "b": "beta"}), "t1", "m", vectors)
    assert told(one) == {"a": ("t1", 0, 1), "b": ("t1", 1, 1)} and one.mentions.count() == 1
    documents, warnings = wanted(spark, {"a": link, "b": "beta"})
    documents = documents.withColumn("title", F.concat("title", F.lit(" anew")))
    two = ingest.ingest(spark, path, documents, warnings, "t2", "m", vectors)
    assert told(two) == {"a": ("t2", 0, 1), "b": ("t2", 1, 1)} and two.mentions.count() == 1
    assert {r["id"]: r["title"] for r in two.documents.collect()} == {"a": "Title a anew", "b": "Title b"}
    three = ingest.ingest(spark, path, documents, warnings, "t3", "other", vectors)
    assert told(three) == {"a": ("t3", 0, 3), "b": ("t3", 1, 3)} and three.mentions.count() == 1
    four = ingest.ingest(spark, path, documents, warnings, "t4", "other", vectors, rebuild=True)
    assert told(four) == {"a": ("t4", 0, 4), "b": ("t4", 1, 4)} and four.mentions.count() == 1
    five = ingest.ingest(spark, path, *wanted(spark, {"a": "alpha", "b": ""}), "t5", "other", vectors)
    assert told(five) == {"a": ("t5", 1, 5), "b": ("t5", 0, 5)} and five.chunks.count() == 1 and five.mentions.count() == 0
