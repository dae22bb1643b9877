"""The index as a directory of Parquet tables, and JSON-lines checkpoints."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.schemas import TABLES

POINTER, POINTERS = "current", "version string, number long"


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}


def _pointers(spark: SparkSession, path: str) -> DataFrame:
    """(version, number) of all snapshots; numbers grow with each write."""
    try:
        return spark.read.schema(POINTERS).json(f"{path}/{POINTER}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], POINTERS)
        raise


def write(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> str:
    """Write a new version beside the others, then point to it: readers see the old
    snapshot or the new one, never a part of either."""
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
    number = (_pointers(spark, path).agg(F.max("number")).collect()[0][0] or 0) + 1
    spark.createDataFrame([(version, number)], POINTERS).coalesce(1).write.mode("append").json(f"{path}/{POINTER}")
    return version


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The latest snapshot; empty tables if there is none. Other errors are raised."""
    # of two writers that took one number at once, one wins for all readers
    last = _pointers(spark, path).agg(F.max(F.struct("number", "version"))["version"].alias("v")).collect()[0]["v"]
    if last is None:
        return empty(spark)
    return {name: spark.read.schema(schema).parquet(f"{path}/{last}/{name}") for name, schema in TABLES.items()}


def read_progress(spark: SparkSession, path: str, provider: str, completed_at: str, chunk_count: int) -> DataFrame:
    """(id, embedding) of a JSON-lines checkpoint whose header fits this job; none if
    it does not, if the file is missing, or if any line cannot be read."""
    none = spark.createDataFrame([], "id string, embedding array<float>")
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return none
        raise
    schema = "provider string, sourceCompletedAt string, chunkCount long, id string, embedding array<float>"
    parsed = lines.filter(F.trim("value") != "").select(F.from_json("value", schema).alias("j"), "value")
    head = F.col("j.provider").isNotNull()
    told = parsed.agg(
        F.count_if(F.try_parse_json("value").isNull()).alias("bad"),
        F.count_if(head & (F.col("j.provider") == provider) & (F.col("j.sourceCompletedAt") == completed_at) & (F.col("j.chunkCount") == chunk_count)).alias("fits"),
    ).collect()[0]
    if told["bad"] or not told["fits"]:
        return none
    return parsed.filter(F.col("j.id").isNotNull()).select("j.id", "j.embedding")


def requests(bodies: DataFrame, schema: str, most_bytes: int) -> DataFrame:
    """Request bodies (content_type, body) with parsed and status: 415, 413, 400 or 200."""
    parsed = F.from_json("body", schema)
    status = F.when(~F.lower("content_type").startswith("application/json"), 415).when(F.octet_length("body") > most_bytes, 413).when(F.try_parse_json("body").isNull(), 400).otherwise(200)
    return bodies.withColumns({"parsed": parsed, "status": status})
