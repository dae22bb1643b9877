"""Which operator answers a question: reports by their dates, or retrieval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from siltstone.functions.dates import dense, month_filter, recent_limit, route
from siltstone.functions.text import plain_query
from siltstone.operators import reports, search

TOTAL_SHOWN = 12


def routed(documents: DataFrame, query: str, as_of: str) -> Row | None:
    """The kind of one question (see ``dates.route``); None if it needs retrieval."""
    one = documents.sparkSession.range(1).select(dense(F.lit(plain_query(query))).alias("told"))
    one = one.withColumns({"month": month_filter(F.col("told"), int(as_of[:4])), "n": recent_limit(F.col("told"))})
    return one.select(route(F.col("told"), F.col("n"), F.col("month")).alias("r")).collect()[0]["r"]


def sources(documents: DataFrame, chunks: DataFrame, query: str, as_of: str, vector: Sequence[float] | None = None) -> DataFrame:
    """Evidence rows for a question: those of a month, of the most recent reports (for
    totals the last dozen), of the latest one, or what retrieval finds."""
    kind = routed(documents, query, as_of)
    if kind is None:
        found = search.search(documents, chunks, query, vector)
    elif kind["type"] == "recent-list":
        found = reports.recent_sources(documents, kind["limit"], as_of)
    elif kind["type"] in ("monthly-count", "monthly-list"):
        found = reports.month_sources(documents, kind["year"], kind["month"], as_of)
    elif kind["type"] == "total-count":
        found = reports.recent_sources(documents, TOTAL_SHOWN, as_of)
    else:
        found = reports.latest_sources(documents, chunks, query)
    return found.select(*search.RESULT)
