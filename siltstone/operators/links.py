"""Links that documents mention: extraction, merging by canonical URL, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import urls
from siltstone.functions.text import NO_SPACE, line_context
from siltstone.shared import numbered

# Where links stand in a line; white space of any script ends them.
MARKDOWN = rf"(!?)\[([^\]]*)\]\((https?://[^{NO_SPACE})]+)\)"
ANCHOR = r"""(?i)<a\b[^>]*href=["'](https?://[^"']+)["'][^>]*>(.*?)</a>"""
BARE = rf"""https?://[^{NO_SPACE}<>"']+"""


def _matches(line: Column) -> Column:
    """array of struct(kind, pos, label, url): markdown links without images, then
    anchors, then bare URLs that no link or image covers."""
    made = "array<struct<kind:int,pos:int,label:string,url:string>>"

    def found(text: Column, kind: int, pattern: str, label: int, url: int, skip: int | None = None) -> Column:
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        one = lambda m, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("pos"), (F.regexp_extract(m, pattern, label) if label else F.lit("")).alias("label"), F.regexp_extract(m, pattern, url).alias("url")
        )
        if skip is not None:
            whole = F.filter(whole, lambda m: F.regexp_extract(m, pattern, skip) == "")
        return F.transform(whole, one).cast(made)

    # blank what links cover, so that only bare URLs are left
    bare = F.regexp_replace(F.regexp_replace(line, MARKDOWN, " "), ANCHOR, " ")
    return F.concat(found(line, 0, MARKDOWN, 2, 3, skip=1), found(line, 1, ANCHOR, 2, 1), found(bare, 2, BARE, 0, 0))


def extract(docs: DataFrame) -> DataFrame:
    """One row for each canonical URL of each document (documentId, documentTitle,
    documentUrl, markdown), its first mention: id, url, title, domain, category,
    context and pos, which orders the links of a document."""
    lines = docs.select("documentId", "documentTitle", "documentUrl", F.posexplode(F.split("markdown", r"\r?\n")).alias("line_no", "line")).filter(F.contains("line", F.lit("http")))
    each = lines.withColumn("context", line_context(F.col("line"))).select("documentId", "documentTitle", "documentUrl", "line_no", "context", F.explode(_matches(F.col("line"))).alias("m"))
    kept = each.withColumn("url", urls.sanitize(F.col("m.url"))).filter(F.col("url").isNotNull() & urls.is_resource(F.col("url"), F.col("documentUrl")))
    place = F.struct("line_no", "m.kind", "m.pos")
    first = kept.groupBy("documentId", "url").agg(F.min(F.struct(place.alias("place"), F.col("m.label").alias("label"), "context", "documentTitle", "documentUrl")).alias("f"))
    named = first.select("documentId", "f.documentTitle", "f.documentUrl", "url", "f.label", "f.context", F.col("f.place").alias("pos")).withColumn("domain", urls.domain(F.col("url")))
    titled = named.withColumn("title", urls.choose_title(F.col("label"), F.col("context"), F.col("domain")))
    return titled.select(
        F.substring(F.sha1("url"), 1, 16).alias("id"), "url", "title", "domain", urls.categorize(F.col("title"), F.col("context"), F.col("domain")).alias("category"),
        "documentId", "documentTitle", "documentUrl", "context", "pos",
    )


def resources(candidates: DataFrame, order: list[Column]) -> DataFrame:
    """One row for each URL: id, url, title (the best), domain, category (which most
    mentions voted for), n_mentions (distinct ones) and first_document. ``order``
    ranks candidates; the first wins ties. All are aggregates that combine before
    they shuffle; no URL's mentions are gathered.
    """
    ranked = candidates.withColumn("place", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    votes = ranked.groupBy("url", "category").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    # least of (-votes, first seen) wins
    category = votes.groupBy("url").agg(F.min_by("category", F.struct(-F.col("n"), "first")).alias("category"))
    best = ranked.groupBy("url").agg(
        F.min("id").alias("id"), F.min("domain").alias("domain"), F.min_by("title", F.struct(-urls.title_quality(F.col("title"), F.col("domain")), "place")).alias("title")
    )
    told = mentions(candidates, order).groupBy("url").agg(F.count("*").alias("n_mentions"), F.min(F.struct("place", "documentId")).alias("first"))
    return best.join(category, "url").join(told, "url").select("id", "url", "title", "domain", "category", "n_mentions", F.col("first.documentId").alias("first_document"))


def mentions(candidates: DataFrame, order: list[Column]) -> DataFrame:
    """One row for each document and context that mention a URL: url, place,
    documentId, documentTitle, documentUrl, context."""
    ranked = candidates.withColumn("place", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    told = ranked.groupBy("url", "documentId", "context").agg(F.min(F.struct("place", "documentTitle", "documentUrl")).alias("m"))
    return told.select("url", "m.place", "documentId", "m.documentTitle", "m.documentUrl", "context")


def merge(candidates: DataFrame, order: list[Column]) -> DataFrame:
    """``resources`` with the distinct mentions nested in one array for each URL, for
    callers that want them so; the array is as long as the URL has mentions."""
    each = mentions(candidates, order)
    mention = F.struct("place", "documentId", "documentTitle", "documentUrl", "context")
    nested = each.groupBy("url").agg(F.array_sort(F.collect_list(mention)).alias("mentions"))
    plain = F.transform("mentions", lambda m: F.struct(m["documentId"].alias("documentId"), m["documentTitle"].alias("documentTitle"), m["documentUrl"].alias("documentUrl"), m["context"].alias("context")))
    return resources(candidates, order).join(nested, "url").select("id", "url", F.col("url").alias("normalizedUrl"), "title", "domain", "category", plain.alias("mentions"))


def numeric_key(text: Column) -> Column:
    """Digit runs padded, so that text order counts 2 before 10."""
    parts = F.regexp_extract_all(text, F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def category_order(spark) -> DataFrame:
    return spark.createDataFrame([(c, i) for i, c in enumerate(urls.CATEGORIES)], "category string, ord int")


def listed(resources: DataFrame) -> DataFrame:
    """Resources by the order of categories, then by title with numbers in order."""
    ordered = resources.join(F.broadcast(category_order(resources.sparkSession)), "category", "left")
    return ordered.orderBy("ord", F.collate(numeric_key(F.col("title")), "zh"), "url").drop("ord")


def placed(resources: DataFrame) -> DataFrame:
    """``listed`` with each resource's place in the list, from one up."""
    ordered = resources.join(F.broadcast(category_order(resources.sparkSession)), "category", "left")
    return numbered(ordered, [F.col("ord"), F.collate(numeric_key(F.col("title")), "zh"), F.col("url")]).drop("ord")


def category_counts(resources: DataFrame) -> DataFrame:
    """category, ord, n for all categories, also those without resources."""
    counts = resources.groupBy("category").agg(F.count("*").alias("n"))
    return category_order(resources.sparkSession).join(counts, "category", "left").select("category", "ord", F.coalesce("n", F.lit(0)).alias("n"))


def domain_count(resources: DataFrame) -> DataFrame:
    """One row: how many domains the resources have."""
    return resources.agg(F.count_distinct("domain").alias("n_domains"))


def carried(mentions: DataFrame, failed: DataFrame) -> DataFrame:
    """Mentions of the last snapshot in documents (id) that could not be read now:
    they stay, as nothing is known of these documents' new text."""
    return mentions.join(failed.select(F.col("id").alias("documentId")), "documentId", "left_semi")


def default_category(resources: DataFrame) -> DataFrame:
    return category_counts(resources).filter("n > 0").agg(F.min_by("category", "ord").alias("category"))


def filtered(resources: DataFrame, category: str | None, said: str) -> DataFrame:
    """By category and by free text in titles, domains and mentions."""
    mentioned = F.flatten(F.transform("mentions", lambda m: F.array(m["documentTitle"], m["context"])))
    hay = F.lower(F.concat_ws(" ", "title", "domain", "category", F.concat_ws(" ", mentioned)))
    out = resources.filter(F.contains(hay, F.lit(said.strip().lower())))
    return out if category is None else out.filter(F.col("category") == category)


def matching(resources: DataFrame, mentions: DataFrame, category: str | None, said: str) -> DataFrame:
    """As ``filtered``, with mentions as rows: free text is looked for in a resource's
    title, domain and category, or in any mention's title and context."""
    want = F.lit(said.strip().lower())
    has = lambda *names: F.contains(F.lower(F.concat_ws(" ", *names)), want)
    some = resources if category is None else resources.filter(F.col("category") == category)
    hits = mentions.filter(has("documentTitle", "context")).select("url").distinct().withColumn("__hit", F.lit(True))
    return some.join(hits, "url", "left").filter(has("title", "domain", "category") | F.col("__hit").isNotNull()).select(*some.columns)


def repaired(resources: DataFrame, root_url: str) -> DataFrame:
    """Stored resources with canonical URLs: invalid ones go, those that become one
    are merged, mentions are told apart by document and context."""
    clean = resources.withColumn("pos", F.monotonically_increasing_id()).withColumn("clean", urls.sanitize(F.col("url"))).filter("clean is not null")
    first = clean.groupBy("clean").agg(F.min_by(F.struct("id", "title", "domain", "category"), "pos").alias("r"))
    each = clean.select("clean", "pos", F.posexplode("mentions").alias("at", "m"))
    told = each.groupBy("clean", F.col("m.documentId").alias("documentId"), F.col("m.context").alias("context")).agg(F.min(F.struct("pos", "at", F.col("m.documentTitle").alias("title"), F.col("m.documentUrl").alias("url"))).alias("f"))
    told = told.withColumn("documentUrl", F.coalesce(urls.sanitize(F.col("f.url")), F.lit(root_url)))
    mention = F.struct("f.pos", "f.at", F.struct("documentId", F.col("f.title").alias("documentTitle"), "documentUrl", "context").alias("m"))
    mentions = told.groupBy("clean").agg(F.transform(F.array_sort(F.collect_list(mention)), lambda x: x["m"]).alias("mentions"))
    none = F.array().cast(resources.schema["mentions"].dataType)
    return first.join(mentions, "clean", "left").select("r.id", F.col("clean").alias("url"), F.col("clean").alias("normalizedUrl"), "r.title", "r.domain", "r.category", F.coalesce("mentions", none).alias("mentions"))
