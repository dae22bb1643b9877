"""Benchmark decontamination with a distributed positional inverted index.

1. The benchmark's items are cut into windows of ten words; equal windows become
   one phrase.
2. One pass over the training texts stores postings (term, document, position)
   of all terms that occur in the benchmark.
3. Each phrase looks up its rarest term first: its postings, moved back by the
   term's offset, are the possible starts; they are intersected with the moved
   postings of the next rarest term.
4. What is left is held against the words of the documents.

Everything is DataFrame operations. Phrases and terms are broadcast only below
a checked count; postings, candidates and texts are only ever joined by shuffle.

Cases: a null text has no words; items without words are ignored; repeated
documents give a row each; documents with one id, or none, and different texts
are told apart by a hash of both; empty tables give no rows, or no hits; other
columns are kept, those that clash with result columns (whose names are a
parameter) are replaced; names that begin with two underscores are ours.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.shared import store

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
BROADCAST_ROWS = 500_000  # rows of some 100 bytes


def words(text: Column) -> Column:
    """Words of lower-cased (A-Z) text: runs of letters, digits and all beyond ASCII."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, SEPARATORS), "")


def _small(df: DataFrame) -> DataFrame:
    """A hint to broadcast a stored table, if its checked count allows it."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def phrases(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """phrase_id, phrase (its words), items (ids of the items that have it)."""
    cut = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    each = cut.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), window).alias("phrase"))
    # an item without an id has windows, but no name to report
    found = each.groupBy("phrase").agg(F.collect_set("item").alias("items"))
    return store(found.withColumn("phrase_id", F.monotonically_increasing_id()), "phrases")


def index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored postings (term_id, doc_id, pos) of the given terms (term, term_id)."""
    tokens = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(words(F.col(text_col))).alias("pos", "term"))
    return store(tokens.join(_small(terms), "term").select("term_id", "doc_id", "pos"), "postings")


def search_terms(found: DataFrame) -> DataFrame:
    """Stored distinct terms of phrases with ids."""
    return store(found.select(F.explode("phrase").alias("term")).distinct().withColumn("term_id", F.monotonically_increasing_id().cast("long")), "terms")


def _by_rarity(found: DataFrame, terms: DataFrame, postings: DataFrame) -> DataFrame:
    """phrase_id and its (n, offset, term_id), rarest first; phrases with a term
    that no document has are left out."""
    counts = postings.groupBy("term_id").agg(F.count("*").alias("n"))
    rated = store(terms.join(counts, "term_id"), "terms")  # counts meet terms, not their occurrences in phrases
    each = found.select("phrase_id", F.size("phrase").alias("size"), F.posexplode("phrase").alias("offset", "term"))
    known = each.join(_small(rated), "term")
    ranked = known.groupBy("phrase_id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "offset", "term_id"))).alias("by"))
    return store(ranked.filter(F.size("by") == F.col("size")).select("phrase_id", "by"), "rarest")


def _starts(postings: DataFrame, ranked: DataFrame, which: int) -> DataFrame:
    """Where phrases would start, going by the postings of one of their terms."""
    look = ranked.filter(F.size("by") > which).select("phrase_id", F.col("by")[which]["term_id"].alias("term_id"), F.col("by")[which]["offset"].alias("offset"))
    return postings.join(_small(look), "term_id").select("phrase_id", "doc_id", (F.col("pos") - F.col("offset")).alias("start")).filter("start >= 0")


def candidates(found: DataFrame, terms: DataFrame, postings: DataFrame) -> DataFrame:
    """(phrase_id, doc_id, start) at which the two rarest terms of a phrase stand
    as far apart as in it (its only term, for phrases of one word)."""
    ranked = _by_rarity(found, terms, postings)
    first, second = _starts(postings, ranked, 0), _starts(postings, ranked, 1)
    short = ranked.filter(F.size("by") == 1).select("phrase_id")
    keys = ["phrase_id", "start"]
    met = first.alias("a").join(second.distinct().alias("b"), (F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))) & (F.col("a.phrase_id") == F.col("b.phrase_id")) & (F.col("a.start") == F.col("b.start")), "left_semi")
    return met.select("doc_id", *keys).unionByName(first.join(short, "phrase_id", "left_semi").select("doc_id", *keys))


def mark(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", names: tuple[str, str, str] = ("n_words", "n_hit", "items")) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside an occurrence of a window) and
    items (ids of the items with occurring windows), under these ``names``."""
    base = docs.drop(*names)
    keyed = base.withColumn("__id", F.xxhash64(F.col(id_col), F.col(text_col)))
    found = phrases(items, window, item_col)
    terms = search_terms(found)
    postings = index(keyed, terms, "__id", text_col)
    near = candidates(found, terms, postings).join(_small(found), "phrase_id")
    by_doc = near.groupBy("doc_id").agg(F.collect_set(F.struct("start", "phrase", "items")).alias("__near")).withColumnRenamed("doc_id", "__doc")
    both = keyed.join(by_doc, F.col("__id") == F.col("__doc"), "left").drop("__doc", "__id")
    both = both.withColumn("__words", words(F.col(text_col)))
    exact = F.filter("__near", lambda c: F.slice("__words", c["start"] + 1, F.size(c["phrase"])) == c["phrase"])
    both = both.withColumn("__hits", F.array_sort(F.coalesce(exact, F.array().cast(both.schema["__near"].dataType))))
    end = lambda c: c["start"] + F.size(c["phrase"])
    covered = F.aggregate(
        "__hits",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, c: F.struct(F.greatest(acc["end"], end(c)).alias("end"), (acc["n"] + F.greatest(F.lit(0), end(c) - F.greatest(acc["end"], c["start"]))).alias("n")),
        lambda acc: acc["n"],
    )
    return both.select(
        *base.columns,
        F.size("__words").cast("long").alias(names[0]),
        covered.cast("long").alias(names[1]),
        F.array_distinct(F.flatten(F.transform("__hits", lambda c: c["items"]))).alias(names[2]),
    )


def proximity(docs: DataFrame, items: DataFrame, slack: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(phrase_id, doc_id, start) of places where all words of a phrase stand, in
    any order, within its length plus ``slack``, the rarest being looked up first.
    """
    found = phrases(items, window, item_col)
    terms = search_terms(found)
    postings = index(docs, terms, id_col, text_col)
    ranked = _by_rarity(found, terms, postings)
    first = postings.join(_small(ranked.select("phrase_id", F.col("by")[0]["term_id"].alias("term_id"), F.size("by").alias("size"))), "term_id").select("phrase_id", "size", "doc_id", F.col("pos").alias("anchor"))
    wanted = ranked.select("phrase_id", F.explode("by").alias("b")).groupBy("phrase_id", F.col("b.term_id").alias("term_id")).agg(F.count("*").alias("times"))
    distinct = wanted.groupBy("phrase_id").agg(F.count("*").alias("terms"))
    spread = first.join(_small(wanted), "phrase_id")
    near = spread.join(postings, ["doc_id", "term_id"]).filter(F.abs(F.col("pos") - F.col("anchor")) < F.col("size") + slack)
    # a window of positions that starts at each of them, as the leftmost word
    starts = near.select("phrase_id", "doc_id", "anchor", F.col("pos").alias("start")).distinct()
    inside = starts.join(near, ["phrase_id", "doc_id", "anchor"]).filter((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + F.col("size") + slack))
    held = inside.groupBy("phrase_id", "doc_id", "anchor", "start", "term_id").agg(F.count_distinct("pos").alias("n"), F.first("times").alias("times")).filter("n >= times")
    full = held.groupBy("phrase_id", "doc_id", "anchor", "start").agg(F.count("*").alias("terms"))
    return full.join(distinct, ["phrase_id", "terms"], "left_semi").select("phrase_id", "doc_id", "start").distinct()
