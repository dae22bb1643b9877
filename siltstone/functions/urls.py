"""URLs: cleaning, canonical form, domains, titles and categories of links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import clean_text, trim

# Parameters that only track, and such that give access.
TRACKING = ["chksm", "from", "from_source", "mpshare", "scene", "share_token", "sharer_shareinfo", "sharer_shareinfo_first", "srcid"]
SENSITIVE = ["access_token", "api_key", "apikey", "auth", "authorization", "code", "credential", "key", "password", "refresh_token", "secret", "sig", "signature", "token"]
# Hosts that hold no resources.
BLOCKED_HOSTS = ["internal-api-drive-stream.feishu.cn", "lf3-static.bytednsdoc.com", "p3-sign.douyinpic.com"]
# Labels that name nothing.
GENERIC_TITLES = ["链接", "资源链接", "原文", "查看", "详情", "点击查看", "点击阅读", "阅读原文", "网址", "地址", "link", "url"]
# Categories in their order, with the words that speak for them.
CATEGORIES: dict[str, list[str]] = {
    "AI编程与智能体": ["ai编程", "编程", "代码", "开发", "程序员", "智能体", "agent", "codex", "claude code", "cursor", "windsurf", "github", "vscode", "opencode", "copilot", "代码生成"],
    "Skill / 知识库 / 工作流": ["skill", "skills", "知识库", "工作流", "workflow", "rag", "mcp", "dify", "coze", "扣子", "n8n", "zapier", "make.com", "自动化", "prompt", "提示词", "检索增强"],
    "教育与学习": ["教育", "学习", "课程", "教程", "培训", "训练营", "公开课", "讲座", "课堂", "学校", "学生", "老师", "study", "learn", "course", "tutorial", "edu"],
    "模型与行业动态": ["模型", "大模型", "行业", "融资", "发布", "测评", "报告", "研究", "论文", "openai", "anthropic", "deepseek", "gemini", "gpt", "claude", "qwen", "通义", "豆包", "kimi", "llama", "huggingface", "modelscope", "arxiv", "benchmark"],
    "内容创作与设计": ["内容创作", "创作", "设计", "写作", "公众号", "小红书", "视频", "剪辑", "生图", "图片", "海报", "ppt", "figma", "canva", "midjourney", "luma", "runway", "pika", "suno", "sora", "即梦", "剪映", "notion"],
    "其他": [],
    "硬件与产品": ["硬件", "产品", "设备", "机器人", "眼镜", "手机", "电脑", "芯片", "算力", "显卡", "gpu", "nvidia", "英伟达", "apple", "meta quest", "ar眼镜", "vr", "无人机"],
}
OTHER = "其他"


# Signs that close a link in running text, names of pictures, titles that are only a date.
CLOSING = r"[)）\]】}>》，。；;！!？?、]+$"
PICTURE = r"\.(?:avif|gif|jpe?g|png|svg|webp)$"
DATE_ONLY = r"^\d{4}[-./年]\d{1,2}(?:[-./月]\d{1,2}日?)?$"


def clean_url(url: Column) -> Column:
    """Without blanks around, escaped ampersands and closing signs at the end."""
    return F.regexp_replace(F.regexp_replace(trim(url), "(?i)&amp;", "&"), CLOSING, "")


def _droppable(name: Column) -> Column:
    low = F.lower(name)
    return low.isin(TRACKING + SENSITIVE) | low.rlike("^(?:utm_|x-amz-|x-goog-)") | low.rlike("_(?:token|signature)$")


def decoded(part: Column) -> Column:
    """A name or value of a query as a form means it; a percent sign that begins no
    escape stands for itself."""
    return F.url_decode(F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25"))


def _escaped(text: Column, unsafe: str) -> Column:
    """Characters of a class, and all beyond ASCII, as percent escapes of UTF-8."""
    bad = rf"[^\x21-\x7e]|[{unsafe}]"
    runs = F.regexp_extract_all(text, F.lit(rf"(?:{bad})+|(?:(?!{bad}).)+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(rf"^(?:{bad})"), F.replace(F.url_encode(r), F.lit("+"), F.lit("%20"))).otherwise(r)), "")


def _segments(path: Column) -> Column:
    """A path without dot segments: a fold over its segments with a stack."""
    parts = F.split(F.regexp_replace(F.translate(path, "\\", "/"), "^/", ""), "/")
    last = lambda i: i == F.size(parts) - 1
    empty = F.array(F.lit(""))

    def step(stack: Column, part: Column) -> Column:
        word = F.replace(F.lower(part["s"]), F.lit("%2e"), F.lit("."))
        up = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        closed = lambda kept: F.when(part["last"], F.concat(kept, empty)).otherwise(kept)
        return F.when(word == "..", closed(up)).when(word == ".", closed(stack)).otherwise(F.concat(stack, F.array(part["s"])))

    each = F.transform(parts, lambda x, i: F.struct(x.alias("s"), last(i).alias("last")))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(each, F.array().cast("array<string>"), step), "/"))


def _ascii_host(host: Column) -> Column:
    """A host as the network knows it: labels beyond ASCII by Punycode, null if there is no such
    name. Spark takes the call for nondeterministic, so it stands in projections, not in aggregates."""
    named = F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), decoded(host))
    plain = F.when(host.rlike(r"[^\x00-\x7f]|%"), F.lower(named)).otherwise(host)
    return F.when(~plain.rlike(r"[\x00-\x20#%/<>?@\\^|]"), plain)


def sanitize(url: Column) -> Column:
    """The canonical form of an http(s) URL, null for anything else: host in lower case
    and ASCII, without default port, dot segments, closing slashes, fragment, and
    tracking and secret parameters, whose names are told by what they decode to. As
    in a URL parser, a query is written anew only if a parameter is taken out."""
    text = clean_url(url)
    begin = r"(?i)^(https?):[/\\]{2}((?:[^/?#\\]*@)?)(\[[0-9a-f:.]+\]|[^/?#\\:@\s]+)(?::(\d*))?(?=[/?#\\]|$)([^?#]*)"
    part = lambda i: F.regexp_extract(text, begin, i)
    scheme, port = F.lower(part(1)), part(4).try_cast("int")
    host = _ascii_host(F.lower(part(3)))
    usual = F.when(scheme == "http", 80).otherwise(443)
    number = F.when(port.isNull() | (port == usual), "").otherwise(F.concat(F.lit(":"), port.cast("string")))
    path = F.regexp_replace(_segments(_escaped(part(5), '"<>`{}^')), "/+$", "")
    query = F.regexp_extract(text, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    name = lambda p: decoded(F.split_part(p, F.lit("="), F.lit(1)))
    value = lambda p: decoded(F.regexp_extract(p, "(?s)=(.*)$", 1))
    kept = F.filter(pairs, lambda p: ~_droppable(name(p)))
    anew = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(name(p)), F.lit("="), F.url_encode(value(p)))), "&")
    as_is = F.when(text.rlike(r"^[^?#]*\?"), F.concat(F.lit("?"), _escaped(query, "\"<>'"))).otherwise("")
    asked = F.when(F.size(kept) == F.size(pairs), as_is).when(F.size(kept) > 0, F.concat(F.lit("?"), anew)).otherwise("")
    ok = text.rlike(begin) & F.coalesce(port.between(0, 65535), part(4) == "")
    return F.when(ok, F.concat(scheme, F.lit("://"), part(2), host, number, F.when(path == "", "/").otherwise(path), asked))


def host_of(url: Column) -> Column:
    """Of a canonical URL, without user and port."""
    return F.regexp_replace(F.regexp_extract(url, r"^https?://(?:[^/?#]*@)?([^/?#]*)", 1), r":\d+$", "")


def domain(url: Column) -> Column:
    return F.regexp_replace(host_of(url), r"^www\.", "")


def is_resource(url: Column, document_url: Column) -> Column:
    host, path = host_of(url), F.lower(F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1))
    blocked = host.isin("file", "localhost")
    for name in BLOCKED_HOSTS:
        blocked = blocked | F.contains(host, F.lit(name))
    return ~(url.eqNullSafe(sanitize(document_url))) & ~blocked & ~path.rlike(PICTURE)


def title_quality(title: Column, name: Column) -> Column:
    low = F.lower(trim(title))
    return (
        F.when((low == "") | (low == name) | low.isin(GENERIC_TITLES) | low.rlike("^https?://"), 0)
        .when(low.rlike(DATE_ONLY), 1)
        .otherwise(F.least(F.lit(100), F.length(title) + 20))
    )


def choose_title(label: Column, context: Column, name: Column) -> Column:
    a, b = (F.substring(clean_text(x), 1, 120) for x in (label, context))
    return F.when(title_quality(a, name) > 1, a).when(title_quality(b, name) > 1, b).otherwise(name)


def categorize(title: Column, context: Column, name: Column) -> Column:
    """The category whose words occur most, threefold in the title; the first of
    equal ones, and the rest category if no word occurs."""
    low = F.lower(title)
    hay = F.lower(F.concat_ws(" ", title, context, name))
    scores = []
    for i, (category, words) in enumerate(CATEGORIES.items()):
        if words:
            told = F.aggregate(F.array(*map(F.lit, words)), F.lit(0), lambda s, w: s + F.when(F.contains(low, w), 3).when(F.contains(hay, w), 1).otherwise(0))
            scores.append(F.struct(told.alias("score"), F.lit(-i).alias("ord"), F.lit(category).alias("category")))
    best = F.greatest(*scores)
    return F.when(best["score"] > 0, best["category"]).otherwise(OTHER)
