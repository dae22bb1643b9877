"""Text expressions: tokens, cleaning, excerpts, redaction. Columns in, columns out."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space as the query side trims it: ASCII, no-break and ideographic spaces.
SPACE = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
NO_SPACE = SPACE[1:-1]  # to be put into a negated class
LATIN = "[a-z0-9][a-z0-9._+-]*"
CJK = "[\\u3400-\\u9fff]+"

# Words that are never tokens.
STOP_WORDS = ["的", "了", "和", "是", "在", "有", "与", "及", "或", "一个", "我们", "这个", "什么", "怎么", "如何", "哪些", "the", "and", "for", "with", "that", "this"]
# Phrases of a question that say nothing about its topic.
QUERY_NOISE = (
    "请问|请帮我|帮我|麻烦|能否|可以|一下|相关|关于|当前|目前|最近|近期|群里面|群里|群中|聊天中|讨论了|讨论|分享了什么|分享了|有哪些|有哪几|哪几个|哪一些|什么内容|什么|如何|怎么|怎样|为何|为什么|是否|有没有|告诉我|列出|整理|总结|查看"
)
# Names that stand for each other; the first that occurs is replaced.
REWRITES = [
    ("智能体", "Agent"),
    ("Agent", "智能体"),
    ("大语言模型|大模型", "LLM"),
    ("LLM", "大模型"),
    ("检索增强生成|检索增强", "RAG"),
    ("RAG", "检索增强生成"),
    ("模型上下文协议|上下文协议", "MCP"),
    ("MCP", "模型上下文协议"),
    ("飞书", "Lark"),
    ("Lark", "飞书"),
]
# What precedes a secret; the secret itself follows.
SECRETS = [
    (r"(?i)(Bearer\s+)[A-Za-z0-9._~+/=-]+"),
    (r"(?i)([?&](?:token|key|api_key|apikey|signature|secret|password)=)[^&\s]+"),
    (r"(?i)((?:api[_-]?key|secret[_-]?key|access[_-]?token|refresh[_-]?token|token|password)\s*[:=]\s*)[^\s,;]+"),
]


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility form. Spark has no such function; apply it once, at
    ingest, and store the result."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def plain_query(query: str) -> str:
    """A query literal in compatibility form."""
    return unicodedata.normalize("NFKC", query)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value computed once. Inside lambdas Spark computes
    common parts anew for every element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(text: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return trim(F.regexp_replace(text, f"{SPACE}+", " "))


def _without(words: Column) -> Column:
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(words, lambda w: ~F.array_contains(stop, w))


def _pairs(run: Column) -> Column:
    """Neighbouring characters of a run. sequence(1, 0) counts down, hence the guard."""
    some = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
    return F.when(F.length(run) > 1, some).otherwise(F.array().cast("array<string>"))


# A stop word that stands alone is passed over; whatever else begins a token is group 1.
_LATIN_OR_STOP = f"(?:{'|'.join(w for w in STOP_WORDS if w.isascii())})(?![a-z0-9._+-])|({LATIN})"


def tokenize(text: Column) -> Column:
    """Tokens of text in compatibility form: Latin ones first, then of each run of
    CJK characters all single ones and all pairs; stop words are left out."""
    low = F.lower(text)
    latin = F.array_remove(F.regexp_extract_all(low, F.lit(_LATIN_OR_STOP), F.lit(1)), "")
    runs = F.regexp_extract_all(low, F.lit(CJK), F.lit(0))
    cjk = F.transform(runs, lambda r: F.concat(_without(F.split(r, "")), _without(_pairs(r))))
    return F.concat(latin, F.flatten(cjk))


def tokens_of(query: str) -> list[str]:
    """tokenize() for a literal on the driver."""
    low = plain_query(query).lower()
    stop = set(STOP_WORDS)
    out = [w for w in re.findall(LATIN, low) if w not in stop]
    for run in re.findall(CJK, low):
        out += [c for c in run if c not in stop]
        out += [p for p in map("".join, zip(run, run[1:], strict=False)) if p not in stop]
    return out


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query, in order: Latin tokens and CJK ones of two characters."""
    quiet = re.sub(QUERY_NOISE, " ", plain_query(query).lower())
    keep = [t for t in tokens_of(quiet) if re.match(r"[a-z0-9]", t) or (re.fullmatch(CJK, t) and len(t) > 1)]
    return list(dict.fromkeys(keep))


def query_terms_column(query: Column) -> Column:
    """query_terms() for a table of queries in compatibility form."""
    words = tokenize(F.regexp_replace(F.lower(query), QUERY_NOISE, " "))
    return F.array_distinct(F.filter(words, lambda t: t.rlike("^[a-z0-9]") | (t.rlike(f"^{CJK}$") & (F.length(t) > 1))))


def clean_markdown(text: Column) -> Column:
    # What is replaced, in this order.
    for pattern, by in (
        (r'(?i)<cite\b[^>]*title="([^"]+)"[^>]*></cite>', "$1"),
        (r"(?i)<synced_reference\b[^>]*></synced_reference>", ""),
        (r"(?i)</?(?:callout|grid|column)\b[^>]*>", ""),
        (r"!\[([^\]]*)\]\([^)]+\)", "$1"),
        (r"https://internal-api-drive-stream\.feishu\.cn/\S+", ""),
        (r"<[^>]+>", " "),
        (r"[ \t]+\n", "\n"),
        (r"\n{3,}", "\n\n"),
    ):
        text = F.regexp_replace(text, pattern, by)
    return trim(text)


def excerpt(content: Column, tokens: Column) -> Column:
    """520 characters around the first of the query's tokens that occurs."""
    long_enough = F.filter(tokens, lambda t: F.length(t) >= 2)

    def first_place(compact: Column) -> Column:
        places = let(F.lower(compact), lambda low: F.filter(F.transform(long_enough, lambda t: F.instr(low, t)), lambda p: p > 0))
        return F.get(places, F.lit(0)) - 1

    def window(compact: Column, place: Column) -> Column:
        start = F.greatest(F.lit(0), place - 160)
        end = F.least(F.length(compact), start + 520)
        cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(compact, start + 1, end - start), F.when(end < F.length(compact), "…").otherwise(""))
        return F.when(place.isNull() | (F.length(compact) <= 500), F.substring(compact, 1, 520)).otherwise(cut)

    return let(squeeze(content), lambda compact: let(first_place(compact), lambda place: window(compact, place)))


def _alone(words: str) -> str:
    """Latin names stand alone, with no ASCII word character beside them."""
    return f"(?i){words}" if not words.isascii() else f"(?i)(?<![A-Za-z0-9_]){words}(?![A-Za-z0-9_])"


def rewrite(query: Column) -> Column:
    """The query with one name replaced, null if none occurs or nothing changes."""
    text = trim(query)
    out = F.lit(None).cast("string")
    for words, by in reversed(REWRITES):
        out = F.when(text.rlike(_alone(words)), trim(F.regexp_replace(text, _alone(words), by))).otherwise(out)
    return F.nullif(out, text)


def rewrite_query(query: str) -> str | None:
    """rewrite() for a literal on the driver."""
    text = plain_query(query).strip()
    for words, by in REWRITES:
        if re.search(_alone(words), text):
            new = re.sub(_alone(words), by, text).strip()
            return None if new == text else new
    return None


def clean_text(text: Column) -> Column:
    # What is replaced, in this order.
    for pattern, by in (
        (r"\\([\[\]()（）])", "$1"),
        (r"<[^>]+>", " "),
        (r"[*_`~]", ""),
        (rf"^{SPACE}*(?:[-+•·]+|\d+[.)、]){SPACE}*", ""),
        (r"[\[\]]", ""),
        (r"^[（(]+|[）)]+$", ""),
        (r"[（(]+$", ""),
        (rf"(?:[\\·]|{SPACE})+$", ""),
    ):
        text = F.regexp_replace(text, pattern, by)
    return squeeze(text)


def line_context(line: Column) -> Column:
    # What is replaced, in this order.
    for pattern, by in ((r"!\[([^\]]*)\]\([^)]+\)", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (rf"""https?://[^{NO_SPACE}<>"']+""", ""), (r"\|", " · ")):
        line = F.regexp_replace(line, pattern, by)
    return F.substring(clean_text(line), 1, 220)


def redact(text: Column) -> Column:
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, "$1[REDACTED]")
    return text


def short_hash(text: Column, n: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)
