"""Sections and overlapping chunks of markdown documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.config import CHUNK_OVERLAP, CHUNK_SIZE, DEFAULT_HEADING
from siltstone.functions.text import clean_markdown, let, tokenize, trim

HEADING = r"^#{1,6}\s+(.+)$"


def sections(markdown: Column) -> Column:
    """array of struct(heading, content) of cleaned text, without a shuffle.

    The places of headings are found first; each section is then one slice of the
    lines, so the work is linear in the text's length.
    """
    lines = F.split(clean_markdown(markdown), r"\r?\n")
    section = "struct<heading:string,content:string>"

    def cut(lines: Column, heads: Column) -> Column:
        def one(at: Column, i: Column) -> Column:
            end = F.coalesce(F.get(heads, i + 1), F.size(lines))
            heading = F.when(at < 0, DEFAULT_HEADING).otherwise(trim(F.regexp_extract(F.get(lines, at), HEADING, 1)))
            content = trim(F.array_join(F.slice(lines, at + 2, F.greatest(end - at - 1, F.lit(0))), "\n"))
            return F.struct(heading.alias("heading"), content.alias("content"))

        return F.filter(F.transform(heads, one), lambda s: s["content"] != "")

    def found(lines: Column) -> Column:
        at = F.filter(F.transform(lines, lambda line, i: F.when(line.rlike(HEADING), i)), lambda i: i.isNotNull())
        return let(F.concat(F.array(F.lit(-1)), at), lambda heads: cut(lines, heads))

    return let(lines, found).cast(f"array<{section}>")


def pieces(content: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Overlapping pieces of at most size characters (one more if a boundary falls
    on the limit). A cut moves back to a paragraph break or full stop if that lies
    beyond the first 400 characters.

    One pattern tells how far each piece's start lies before the next one's: what
    it passes over ends ``overlap`` characters before the cut, which it looks ahead
    to. So one pass over the text finds all cuts, and a piece is what was passed
    over, with the first characters of what follows.
    """
    least = max(400, size - 240)
    if not 0 < overlap < min(least, size):
        raise ValueError("the overlap must be shorter than any piece")
    last = rf".{{1,{size}}}\z"
    marked = rf".{{{least + 1 - overlap},{size + 1 - overlap}}}(?=.{{{overlap - 1}}}(?:[。；]|\n(?=\n)))"
    plain = rf".{{{size - overlap}}}"
    steps = F.regexp_extract_all(content, F.lit(f"(?s){last}|{marked}|{plain}" if least <= size else f"(?s){last}|{plain}"), F.lit(0))
    whole = lambda steps: F.transform(steps, lambda p, i: trim(F.concat(p, F.left(F.coalesce(F.get(steps, i + 1), F.lit("")), F.lit(overlap)))))
    return F.when(F.length(content) <= size, F.array(content)).otherwise(F.filter(let(steps, whole), lambda p: p != ""))


def chunk_documents(docs: DataFrame) -> DataFrame:
    """Chunks of documents (documentId, nodeToken, title, parentTitle, url, markdown):
    sections, cut to pieces, with context lines, tokens, and an id that counts all
    pieces of the document."""
    each = docs.select("documentId", "nodeToken", "title", "parentTitle", "url", F.transform(sections(F.col("markdown")), lambda s: F.struct(s["heading"].alias("heading"), pieces(s["content"]).alias("pieces"))).alias("sections"))
    flat = F.flatten(
        F.transform(
            "sections",
            lambda s: F.transform(
                s["pieces"],
                lambda p, i: F.struct(
                    F.when(F.size(s["pieces"]) > 1, F.concat(s["heading"], F.lit(" · "), i + 1, F.lit("/"), F.size(s["pieces"]))).otherwise(s["heading"]).alias("heading"),
                    s["heading"].alias("section"),
                    p.alias("content"),
                ),
            ),
        )
    )
    out = each.select("documentId", "nodeToken", "title", "parentTitle", "url", F.posexplode(flat).alias("ordinal", "piece"))
    context = F.concat_ws("\n", F.concat(F.lit("文档："), "title"), F.concat(F.lit("目录："), F.nullif("parentTitle", F.lit(""))), F.concat(F.lit("章节："), "piece.section"), F.nullif("piece.content", F.lit("")))
    return out.select(
        F.concat_ws(":", "documentId", F.col("ordinal").cast("string")).alias("id"),
        "documentId",
        "nodeToken",
        "title",
        "parentTitle",
        F.col("piece.heading").alias("heading"),
        "url",
        F.col("piece.content").alias("content"),
        context.alias("contextualText"),
        "ordinal",
    ).withColumn("tokens", tokenize(F.col("contextualText")))
