"""Chunks, ranking, cascade, sync, links, streams and snapshots, on literal rows."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from siltstone.functions import dates
from siltstone.functions.text import tokenize, tokens_of
from siltstone.operators import chunking, conversations, links, reports, search, sync
from siltstone.plans import link_queries
from siltstone.sources import snapshot
from siltstone.streaming import rate_limit


def chunks(spark, rows):
    """rows: id, document, title, heading, text, vector."""
    full = [(i, d, t, "p", h, "u", c, c, v, n) for n, (i, d, t, h, c, v) in enumerate(rows)]
    df = spark.createDataFrame(full, "id string, documentId string, title string, parentTitle string, heading string, url string, content string, contextualText string, embedding array<float>, chunk_pos long")
    return df.withColumn("tokens", tokenize(F.col("contextualText")))


def test_sections_and_pieces(spark):
    body = "句" * 405 + "。" + "尾" * 300
    df = spark.createDataFrame([("d", "n", "T", "P", "u", f"intro\n# One\n{body}\n## Two\n\n# Three\nx"), ("e", "n", "T", "", "u", "")], "documentId string, nodeToken string, title string, parentTitle string, url string, markdown string")
    got = chunking.chunk_documents(df).orderBy("ordinal").collect()
    assert [r["heading"] for r in got] == ["正文", "One · 1/2", "One · 2/2", "Three"]
    assert [r["id"] for r in got] == ["d:0", "d:1", "d:2", "d:3"]
    assert got[1]["content"] == "句" * 405 + "。" and got[2]["content"] == "句" * 69 + "。" + "尾" * 300
    assert got[0]["contextualText"] == "文档：T\n目录：P\n章节：正文\nintro"


def fold(content, size=430, overlap=70):
    out, start = [], 0
    if len(content) <= size:
        return [content]
    while start < len(content):
        end = ideal = min(start + size, len(content))
        if ideal < len(content):
            mark = max(content.rfind("\n\n", start, ideal + 2), content.rfind("。", start, ideal + 1), content.rfind("；", start, ideal + 1))
            if mark >= max(start + 400, ideal - 240):
                end = mark + 1
        if piece := content[start:end].strip():
            out.append(piece)
        if end >= len(content):
            break
        start = max(end - overlap, start + 1)
    return out


def test_pieces_equal_a_plain_fold(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "b", " ", "\n\n", "。", "；", "word "]) for _ in range(rng.randint(0, 900))) for _ in range(30)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chunking.pieces(F.col("t")).alias("p")).collect():
        assert r["p"] == fold(r["t"])


def test_pieces_of_other_sizes_and_line_ends(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["ab", " ", "\n", "\n\n", "。", "\r\n", "漢"]) for _ in range(n)) for n in (0, 1, 215, 429, 430, 431, 860, 3000, 3001)] + [" " * 2000, "。" * 2000, "x" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for size, overlap in ((430, 70), (700, 20), (300, 1)):
        for r in df.select("t", chunking.pieces(F.col("t"), size, overlap).alias("p")).collect():
            assert r["p"] == fold(r["t"], size, overlap)
    with pytest.raises(ValueError):
        chunking.pieces(F.col("t"), 430, 430)


def test_one_text_of_ten_megabytes_is_chunked_in_linear_time(spark):
    """Lines, headings and pieces: the fold before took minutes for a tenth of it."""
    line = "word other 。" * 7 + "\n"
    text = ("# Head\n" + line * 200) * 600 + line * 20_000
    assert len(text) > 10_000_000
    df = spark.createDataFrame([("d", "n", "T", "P", "u", text)], "documentId string, nodeToken string, title string, parentTitle string, url string, markdown string")
    began = time.time()
    told = df.select(F.size(chunking.pieces(F.col("markdown"))).alias("n"), chunking.sections(F.col("markdown")).alias("s")).select("n", F.size("s").alias("sections"), F.length(F.element_at("s", -1)["content"]).alias("last")).collect()[0]
    assert time.time() - began < 20
    assert told["sections"] == 600 and told["last"] > 1_500_000 and told["n"] == len(fold(text))


def test_stop_words_are_whole_tokens(spark):
    text = "The theory and.b for-x this (with) THAT. and+ 那了和 the"
    got = spark.createDataFrame([(text,)], "t string").select(tokenize(F.col("t")).alias("w")).collect()[0]["w"]
    assert got == tokens_of(text) == ["theory", "and.b", "for-x", "that.", "and+", "那", "那了", "了和"]


def test_topic_before_link_list_and_caps(spark):
    rows = [("a:0", "a", "t", "资源链接", "agent memory design", None), ("b:0", "b", "t", "TOP 话题", "agent memory design", None)] + [(f"c:{i}", "c", "t", "h", "agent memory design", None) for i in range(5)]
    got = search.search_index(chunks(spark, rows), "agent memory").collect()
    assert [r["id"] for r in got] == ["b:0", "c:0", "c:1", "c:2", "a:0"]
    assert got[0]["score"] == 0.99 and all(0.6 <= r["score"] <= 0.99 for r in got)


def test_vectors_need_to_be_close(spark):
    rows = [("a:0", "a", "t", "h", "完全无关的内容", [0.6, 0.8]), ("b:0", "b", "t", "h", "另外一段文字", [0.9, 0.4359])]
    got = search.search_index(chunks(spark, rows), "自动化流程", [1.0, 0.0]).collect()
    assert [r["id"] for r in got] == ["b:0"]
    assert search.search_index(chunks(spark, rows), "自动化流程 codex", [1.0, 0.0]).collect() == []  # Latin terms must occur
    assert search.search_index(chunks(spark, rows), "的").collect() == []


def test_cascade(spark):
    df = chunks(spark, [("a:0", "a", "Weekly", "h", "智能体 的 记忆", None)])
    docs = spark.createDataFrame([("a", "Weekly", "Archive", 0), ("z", "Archive Weekly", "", 1)], "id string, title string, parentTitle string, doc_pos long")
    strategy = lambda q: [(r["strategy"], r["effective_query"]) for r in search.search(docs, df, q).collect()]
    assert strategy("智能体 记忆") == [("keyword", "智能体 记忆")]
    assert strategy("Agent") == [("rewritten", "智能体")]
    assert strategy("archive") == [("metadata", "archive")]
    assert strategy("absent") == []


def test_prompt(spark):
    df = chunks(spark, [("a:0", "a", "T", "h", "智能体", None)])
    got = search.prompt(search.search_index(df, "智能体"), "Answer.").collect()[0]["prompt"]
    assert got == "Answer.\n\n可用证据：\n【证据 1】\n文档：T\n目录：p\n章节：h\n原文链接：u\n原文：\n智能体\n"
    assert search.prompt(search.search_index(df, "的"), "A").collect()[0]["prompt"].endswith("没有检索到可用证据。\n")


def test_latest_report_sources_fall_back(spark):
    df = chunks(spark, [("a:0", "a", "T", "h", "x  y", None), ("b:0", "b", "T", "h", "agent", None)])
    docs = spark.createDataFrame([("a", "R 2026-06-01~2026-06-07", "", "u", 0), ("b", "R 2026-05-01~2026-05-07", "", "u", 1)], "id string, title string, parentTitle string, url string, doc_pos long")
    (r,) = reports.latest_sources(docs, df, "agent").collect()
    assert (r["id"], r["excerpt"], r["score"]) == ("a:0", "x y", 1.0)


def test_links_of_a_line(spark):
    text = "- ![p](https://a.b/x.png) [Name \\[1\\]](https://A.b/c/?utm_source=q) and https://a.b/c https://d.e/f）\n<a href='https://g.h/i'>Label</a>\nnone"
    df = spark.createDataFrame([("d", "T", "https://doc/", text)], "documentId string, documentTitle string, documentUrl string, markdown string")
    got = {r["url"]: r for r in links.extract(df).collect()}
    assert set(got) == {"https://a.b/c", "https://d.e/f", "https://g.h/i"}
    assert got["https://g.h/i"]["title"] == "Label" and len(got["https://d.e/f"]["id"]) == 16


def test_resources_without_gathered_mentions(spark):
    rows = [("i", "https://a.b/x", "Some title", "a.b", "A", str(d), f"Doc {d}", "https://d/", f"context {c}", d) for d in range(50) for c in (d % 2, d % 2, 5)]
    rows += [("j", "https://a.b/y", "Other", "a.b", "B", "7", "Doc 7", "https://d/", "nothing", 1)]
    df = spark.createDataFrame(rows, "id string, url string, title string, domain string, category string, documentId string, documentTitle string, documentUrl string, context string, pos int")
    order = [F.col("pos")]
    found, nested = links.resources(df, order), links.merge(df, order)
    want = {(r["url"], r["title"], r["category"], len(r["mentions"]), r["mentions"][0]["documentId"]) for r in nested.collect()}
    assert {(r["url"], r["title"], r["category"], r["n_mentions"], r["first_document"]) for r in found.collect()} == want
    assert {w[3] for w in want} == {100, 1}
    for category, said in (("A", " CONTEXT 1"), (None, "doc 49"), ("B", "context"), (None, "other"), (None, "A.B"), (None, "no such")):
        told = {r["url"] for r in links.matching(found, links.mentions(df, order), category, said).collect()}
        assert told == {r["url"] for r in links.filtered(nested, category, said).collect()}


@pytest.mark.parametrize("name", ["resource_merge", "category_counts", "resource_filter"])
def test_registered_link_queries_gather_no_mentions(spark, name):
    plan = link_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_merge_votes_and_titles(spark):
    rows = [("u", "h", "h", "B", "1", 0), ("u", "Long title", "h", "A", "2", 1), ("u", "Other tops", "h", "A", "2", 2), ("u", "x", "h", "B", "3", 3)]
    df = spark.createDataFrame([(f"id-{u}", u, t, d, c, doc, "T", "du", "ctx", p) for u, t, d, c, doc, p in rows], "id string, url string, title string, domain string, category string, documentId string, documentTitle string, documentUrl string, context string, pos int")
    (r,) = links.merge(df, [F.col("pos")]).collect()
    assert (r["title"], r["category"], [m["documentId"] for m in r["mentions"]]) == ("Long title", "B", ["1", "2", "3"])


def test_repair_of_stored_resources(spark):
    m = lambda d, c, u: (d, "T", u, c)
    rows = [("1", "https://a.b/?utm_x=1", "x", "t", "d", "c", [m("1", "c", "bad")]), ("2", "https://A.b/", "x", "t2", "d", "c", [m("1", "c", "bad"), m("2", "c", "https://x.y/")]), ("3", "nope", "x", "t", "d", "c", [])]
    df = spark.createDataFrame(rows, snapshot.TABLES["resources"])
    (r,) = links.repaired(df, "https://root/").collect()
    assert (r["id"], r["url"], [(x["documentId"], x["documentUrl"]) for x in r["mentions"]]) == ("1", "https://a.b/", [("1", "https://root/"), ("2", "https://x.y/")])


def test_numbers_in_titles_sort_as_numbers(spark):
    rows = [("第10期",), ("第2期",)]
    df = spark.createDataFrame(rows, "t string").orderBy(F.collate(links.numeric_key(F.col("t")), "zh"))
    assert [r["t"] for r in df.collect()] == ["第2期", "第10期"]


def test_attributes_last_wins_and_citations(spark):
    tag = '<cite doc-id="x" title="R 2026-06-01\\~2026-06-07" file-type="DOCX" doc-id="y"></cite>'
    df = spark.createDataFrame([("d", tag + tag + '<cite doc-id="z" title="no range" file-type="docx"></cite>')], "documentId string, markdown string")
    assert [(r["docId"], r["title"]) for r in sync.citations(df).collect()] == [("y", "R 2026-06-01~2026-06-07")]


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "x")], "src string, dst string")
    start, allowed = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert {tuple(r) for r in sync.closure(start, edges, allowed).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_next_chunks_reuse_and_blank(spark):
    old = spark.createDataFrame([("a:0", "a", [1.0]), ("b:0", "b", [1.0]), ("c:0", "c", [1.0])], "id string, documentId string, embedding array<float>")
    new = spark.createDataFrame([("a:0", "a"), ("b:0", "b"), ("n:0", "n")], "id string, documentId string")
    changes = spark.createDataFrame([("a", "unchanged"), ("b", "changed"), ("c", "kept"), ("n", "new")], "id string, change string")
    got = {r["id"]: r["embedding"] for r in sync.next_chunks(changes, old, new, provider_changed=True).collect()}
    assert got == {"a:0": None, "b:0": None, "c:0": [1.0], "n:0": None}


def test_embedding_job_resumes(spark):
    df = spark.createDataFrame([("a", "x", None), ("b", "yy", None)], "id string, contextualText string, embedding array<float>")
    done = spark.createDataFrame([("a", [9.0])], "id string, embedding array<float>")
    made = sync.embed(sync.pending(df, done), lambda texts: [[float(len(t))] for t in texts])
    assert [tuple(r) for r in made.collect()] == [("b", [11.0])]
    assert {r["id"]: r["embedding"] for r in sync.resumed(df, made.unionByName(done)).collect()} == {"a": [9.0], "b": [11.0]}


def test_allowlist(spark):
    df = spark.createDataFrame([(" a, b,,a ",)], "s string")
    assert df.select(sync.allowlist(F.col("s")).alias("x")).collect()[0]["x"] == ["a", "b"]


def test_windows_open_at_the_first_event(spark):
    t = lambda s: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(i, "k", t(s)) for i, s in enumerate([5, 10, 60, 64, 65, 66])] + [(9, "other", t(0))]
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp")
    got = {r["id"]: (r["allowed"], r["remaining"]) for r in rate_limit.limited(df, "key", "ts", 2, 60, "id").collect()}
    assert got == {0: (True, 1), 1: (True, 0), 2: (False, 0), 3: (False, 0), 4: (True, 1), 5: (True, 0), 9: (True, 1)}


def test_windows_over_a_stream_equal_the_batch(spark, tmp_path):
    """Three files, out of order within what the watermark allows, null keys and stamps."""
    t = lambda s: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)
    files = [[("k", 5), ("k", 0), (None, 7), ("m", 3), ("k", None)], [("k", 2), ("k", 61), ("k", 20), (None, 7), ("m", 64)], [("k", 66), ("k", 62), ("m", 63), ("k", 119), ("k", 59), ("z", 600)]]
    for n, rows in enumerate(files):
        df = spark.createDataFrame([(k, None if s is None else t(s)) for k, s in rows], "key string, ts timestamp")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are read in the order of their times
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = rate_limit.limited_stream(stream, "key", "ts", 2, 60)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(180)
    finally:
        spark.conf.unset(store)
    said = lambda df: sorted((str(r["key"]), str(r["ts"]), r["allowed"], r["remaining"], str(r["reset_at"])) for r in df.collect())
    events = spark.createDataFrame([(i, k, None if s is None else t(s)) for i, (k, s) in enumerate(x for f in files for x in f)], "id long, key string, ts timestamp")
    want = rate_limit.limited(events.filter("ts is not null and key is distinct from 'z'"), "key", "ts", 2, 60, "id")  # z only moves the watermark
    assert said(spark.read.parquet(str(tmp_path / "out"))) == said(want)


def test_events_without_a_time_stamp(spark):
    rows = [(1, "a", None), (2, "a", 5), (3, None, None), (4, "a", 6)]
    events = spark.createDataFrame(rows, "id long, key string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: (r["allowed"], r["remaining"], r["reset_at"] is None) for r in rate_limit.limited(events, "key", "ts", 2, 60, "id").collect()}
    assert got == {1: (False, 0, True), 2: (True, 1, False), 3: (False, 0, True), 4: (True, 0, False)}
    assert len(rate_limit.limited(events.filter("ts is null"), "key", "ts", 2, 60, "id").collect()) == 2


def test_conversation_rules(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", " last "), (2, 0, "system", "x"), (2, 1, "user", "y"), (3, 0, "user", "z" * 8001)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r["conv_id"]: r["valid"] for r in conversations.validity(df).collect()} == {1: True, 2: False, 3: False}
    assert {r["conv_id"]: r["question"] for r in conversations.latest_question(df).collect()}[1] == "last"
    assert {r["conv_id"]: r["markdown"] for r in conversations.export(df).collect()}[1] == "**User:** hi\n\n**Assistant:** yo\n\n**User:**  last "


def test_snapshots_and_checkpoints(spark, tmp_path):
    path = str(tmp_path / "index")
    assert all(df.count() == 0 for df in snapshot.read(spark, path).values())
    one = snapshot.empty(spark)
    one["documents"] = spark.createDataFrame([("a", "a", "a", "T", "", "u", 1, "h", None, None, 1, 0)], snapshot.TABLES["documents"])
    snapshot.write(spark, path, one)
    assert snapshot.read(spark, path)["documents"].count() == 1
    snapshot.write(spark, path, snapshot.empty(spark))
    assert snapshot.read(spark, path)["documents"].count() == 0
    file = tmp_path / "p.jsonl"
    head = '{"provider":"m","sourceCompletedAt":"t","chunkCount":2}\n'
    file.write_text(head + '{"id":"a","embedding":[1.0]}\n')
    assert [tuple(r) for r in snapshot.read_progress(spark, str(file), "m", "t", 2).collect()] == [("a", [1.0])]
    assert snapshot.read_progress(spark, str(file), "m", "t", 3).count() == 0
    other = tmp_path / "q.jsonl"
    other.write_text(head + '{"id":"a","embed')
    assert snapshot.read_progress(spark, str(other), "m", "t", 2).count() == 0
    assert snapshot.read_progress(spark, str(tmp_path / "none"), "m", "t", 2).count() == 0


def test_request_bodies(spark):
    rows = [("application/json", '{"q": "x"}'), ("text/plain", "{}"), ("application/json", "{"), ("application/json; charset=utf-8", '{"q": "' + "y" * 99 + '"}')]
    df = spark.createDataFrame(rows, "content_type string, body string")
    assert [r["status"] for r in snapshot.requests(df, "q string", 50).collect()] == [200, 415, 400, 413]


def test_rate_limits_keep_null_and_large_keys(spark):
    at = "2024-01-01 00:00:"
    rows = [(i, k, f"{at}{i % 60:02d}") for i, k in enumerate([None] * 8 + [9007199254740993] * 4 + [9007199254740992] * 4)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, at string").select("event_id", "user_id", F.col("at").cast("timestamp").alias("ts"))
    got = rate_limit.limited(events, "user_id", "ts", 2, 3600, "event_id").collect()
    allowed = {}
    for r in got:
        allowed[r["user_id"]] = allowed.get(r["user_id"], 0) + r["allowed"]
    assert allowed == {None: 2, 9007199254740993: 2, 9007199254740992: 2} and len(got) == 16


def test_rate_limits_equal_a_fold_over_events(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("abc"), rng.randrange(5000)) for i in range(3000)]
    events = spark.createDataFrame(rows, "event_id long, user string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["event_id"]: (r["allowed"], r["remaining"]) for r in rate_limit.limited(events, "user", "ts", 5, 60, "event_id").collect()}
    state, want = {}, {}
    for i, user, s in sorted(rows, key=lambda r: (r[2], r[0])):
        count, reset = state.get(user, (0, -1))
        if reset <= s:
            count, reset = 0, s + 60
        state[user] = count + 1, reset
        want[i] = count + 1 <= 5, max(0, 4 - count)
    assert got == want


def test_ideographic_space_ends_links_and_stands_in_ranges(spark):
    docs = spark.createDataFrame([("d", "t", "https://own.example/d", "see https://a.example/p　and more")], "documentId string, documentTitle string, documentUrl string, markdown string")
    assert [r["url"] for r in links.extract(docs).collect()] == ["https://a.example/p"]
    title = spark.createDataFrame([("report 2024-01-01　~　2024-01-07",)], "title string")
    got = title.select(dates.report_range(F.col("title")).alias("r")).collect()[0]["r"]
    assert (str(got["start"]), str(got["end"])) == ("2024-01-01", "2024-01-07")


def test_tree_walk_ends_in_cycles(spark):
    nodes = spark.createDataFrame([("a", "r"), ("b", "a"), ("a2", "b"), ("r", "a2")], "nodeToken string, parentNodeToken string")
    root = spark.createDataFrame([("r", None)], "nodeToken string, parentNodeToken string")
    assert {(r["nodeToken"], r["depth"]) for r in sync.walk(nodes, root).collect()} == {("r", 0), ("a", 1), ("b", 2), ("a2", 3)}
    with pytest.raises(ValueError, match="levels"):
        sync.walk(nodes, root, depth=2)
    assert sync.walk(nodes, root, depth=4).count() == 4


def test_the_last_of_two_snapshots_written_at_once_is_read(spark, tmp_path):
    tables = snapshot.empty(spark)
    versions = [snapshot.write(spark, str(tmp_path), tables) for _ in range(3)]
    numbers = {r["version"]: r["number"] for r in spark.read.json(f"{tmp_path}/current").collect()}
    assert [numbers[v] for v in versions] == [1, 2, 3]
    assert set(snapshot.read(spark, str(tmp_path))) == set(tables)
