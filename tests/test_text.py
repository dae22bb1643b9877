"""Tokens, cleaning, rewriting and redaction, on literal rows."""

from pyspark.sql import functions as F

from siltstone.functions import text, urls
from siltstone.functions.vectors import cosine


def one(spark, column, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(column.alias("x")).collect()[0]
    return row["x"]


def test_tokens_of_latin_and_cjk(spark):
    got = one(spark, text.tokenize(F.col("c0")), "Agent工作流 and v1.2 World. 我")
    assert got == ["agent", "v1.2", "world.", "工", "作", "流", "工作", "作流", "我"]
    assert got == text.tokens_of("Agent工作流 and v1.2 World. 我")
    assert one(spark, text.tokenize(F.col("c0")), "") == []


def test_query_terms_drop_noise(spark):
    said = "请问 Claude 的工作流 有哪些 工作流"
    want = ["claude", "的工", "工作", "作流"]
    assert text.query_terms(said) == want
    assert one(spark, text.query_terms_column(F.col("c0")), said) == want


def test_compatibility_form(spark):
    assert one(spark, text.nfkc(F.col("c0")), "ＡＢ①") == "AB1"
    assert text.query_terms("ＲＡＧ") == ["rag"]


def test_rewrites_once_by_the_first_rule(spark):
    for said, want in (("用Agent吗", "用智能体吗"), ("大模型和LLM", "LLM和LLM"), ("Agents", None), ("智能体 and agent", "Agent and agent"), ("飞书", "Lark"), ("", None)):
        assert one(spark, text.rewrite(F.col("c0")), said) == want, said
        assert text.rewrite_query(said) == want


def test_markdown_is_cleaned(spark):
    said = '<cite doc-id="1" title="T one"></cite> ![alt](http://x/y.png) <b>a</b>  \n\n\n\n<callout x="1">in</callout>　'
    assert one(spark, text.clean_markdown(F.col("c0")), said) == "T one alt  a\n\nin"


def test_line_context(spark):
    assert one(spark, text.line_context(F.col("c0")), "- [Name](https://a.b/c) | **bold** https://x.y") == "Name · bold"
    assert one(spark, text.clean_text(F.col("c0")), r"1. \[x\] (y)") == "x (y"


def test_redaction(spark):
    said = "Authorization: Bearer abc.def token=xyz https://h/?key=1&a=2 password: p,q"
    assert one(spark, text.redact(F.col("c0")), said) == "Authorization: Bearer [REDACTED] token=[REDACTED] https://h/?key=[REDACTED]&a=2 password: [REDACTED],q"


def test_excerpts(spark):
    long = "x" * 300 + " needle " + "y " * 400
    words = F.array(F.lit("needle"))
    got = one(spark, text.excerpt(F.col("c0"), words), long)
    assert got.startswith("…") and got.endswith("…") and len(got) == 522 and "needle" in got
    assert one(spark, text.excerpt(F.col("c0"), words), "short  needle") == "short needle"
    assert len(one(spark, text.excerpt(F.col("c0"), F.array(F.lit("absent"))), long)) == 520


def test_urls_become_canonical(spark):
    for said, want in (
        ("https://Example.com/a/?utm_source=x&id=42&token=s&X-Amz-Signature=q#frag", "https://example.com/a?id=42"),
        ("http://h.com", "http://h.com/"),
        (" https://h.com/x?from=1&amp;y=2）。", "https://h.com/x?y=2"),
        ("https://h.com:443/p//", "https://h.com/p"),
        ("ftp://h.com/", None),
        ("nothing", None),
        ("https://h.com/?a_token=1&b=2", "https://h.com/?b=2"),
    ):
        assert one(spark, urls.sanitize(F.col("c0")), said) == want, said
        if want:
            assert one(spark, urls.sanitize(urls.sanitize(F.col("c0"))), said) == want


def test_urls_are_parsed(spark):
    """Names by what they decode to, dot segments, ports, hosts beyond ASCII, escapes."""
    for said, want in (
        ("https://e.org/a?%74oken=x&b=1", "https://e.org/a?b=1"),
        ("https://e.org/a?%zz%74oken=x", "https://e.org/a?%zz%74oken=x"),  # the name is %zztoken
        ("https://e.org/a?q=a%20b+c&utm_x=1&e", "https://e.org/a?q=a+b+c&e="),
        ("https://e.org/a?q=a%20b+c&e", "https://e.org/a?q=a%20b+c&e"),
        ("https://e.org/a/./b/../c/%2e%2E/d/", "https://e.org/a/d"),
        ("https://e.org/../..", "https://e.org/"),
        ("https://e.org/a/b/..", "https://e.org/a"),
        ("https://e.org\\a\\b", "https://e.org/a/b"),
        ("HTTP://User:p@Bücher.Example:80/ä b?x=ü#f", "http://User:p@xn--bcher-kva.example/%C3%A4%20b?x=%C3%BC"),
        ("https://例え。テスト/", "https://xn--r8jz45g.xn--zckzah/"),
        ("https://e%2Eorg/", "https://e.org/"),
        ("https://e.org:08443", "https://e.org:8443/"),
        ("https://e.org:99999/", None),
        ("https://[::1]:443/x", "https://[::1]/x"),
        ("https://e.org?a=1&&b=2&utm_q=", "https://e.org/?a=1&b=2"),
        ("https://a b.org/", None),
        ("https://", None),
    ):
        assert one(spark, urls.sanitize(F.col("c0")), said) == want, said
        if want:
            assert one(spark, urls.sanitize(F.col("c0")), want) == want


def test_resource_rules(spark):
    for said, want in (("https://file/x", False), ("https://a.b/pic.PNG", False), ("https://a.b/c", True), ("https://docs.x/1", False)):
        assert one(spark, urls.is_resource(F.col("c0"), F.lit("https://docs.x/1")), said) is want


def test_titles_and_categories(spark):
    assert one(spark, urls.choose_title(F.col("c0"), F.col("c1"), F.lit("h.com")), "链接", "Real context") == "Real context"
    assert one(spark, urls.choose_title(F.col("c0"), F.col("c1"), F.lit("h.com")), "url", "2026-06-01") == "h.com"
    for title, want in (("OpenAI Codex 编程 Agent", "AI编程与智能体"), ("nothing known", "其他"), ("GPU 芯片", "硬件与产品"), ("storage", "Skill / 知识库 / 工作流")):
        assert one(spark, urls.categorize(F.col("c0"), F.lit(""), F.lit("h.com")), title) == want


def test_cosine(spark):
    rows = [([0.6, 0.8], [1.0, 0.0], 0.6), ([0.9, 0.4359], [1.0, 0.0], 0.9), ([1.0], [1.0, 0.0], 0.0), ([], [], 0.0), ([0.0, 0.0], [1.0, 0.0], 0.0), (None, [1.0], 0.0)]
    df = spark.createDataFrame(rows, "a array<float>, b array<double>, want double")
    for r in df.select(cosine(F.col("a"), F.col("b")).alias("got"), "want").collect():
        assert abs(r["got"] - r["want"]) < 1e-4
