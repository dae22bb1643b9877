"""A checkpoint of embeddings as a data source: JSON lines in parts, one for each task.

A part begins with a header that tells for which model and which state of the
chunks it was made. A task writes its part under a hidden name and moves it when
it is whole, so a job that is stopped leaves whole parts only, and a repeated
attempt of a task replaces its own. Parts with another header, or that cannot be
read, count for nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from siltstone.operators import sync

NAME, SCHEMA = "embedding_progress", "id string, embedding array<float>"
PART_ROWS = 4_096  # chunks of a task of the job


def _header(options: dict) -> dict:
    lower = {k.lower(): v for k, v in options.items()}
    return {"type": "header", "provider": lower["provider"], "sourceCompletedAt": lower["completedat"], "chunkCount": int(lower["chunkcount"])}


class _Part(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.header = options["path"], _header(options)

    def partitions(self) -> list[InputPartition]:
        files, root = fs.FileSystem.from_uri(self.path)
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [_Part(f.path) for f in found if f.base_name.startswith("part-")] or [_Part("")]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []
        if partition.value:
            files, _ = fs.FileSystem.from_uri(self.path)
            try:
                with files.open_input_stream(partition.value) as lines:
                    head, *rows = lines.read().decode().splitlines()
                records = [json.loads(r) for r in rows if r]
                if json.loads(head) == self.header:
                    records = [r for r in records if r.get("type") == "embedding" and r.get("id") and r.get("embedding")]
                    ids, vectors = [r["id"] for r in records], [[float(x) for x in r["embedding"]] for r in records]
            except (ValueError, TypeError, AttributeError):  # no header, no JSON, no record
                ids, vectors = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(vectors, pa.list_(pa.float32()))], names=["id", "embedding"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.header, self.job = options["path"], _header(options), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = fs.FileSystem.from_uri(self.path)
        files.create_dir(root, recursive=True)
        name = f"{self.job}-{TaskContext.get().partitionId()}.jsonl"
        hidden, rows = f"{root}/.{uuid.uuid4().hex}-{name}", 0
        with files.open_output_stream(hidden) as out:
            out.write((json.dumps(self.header) + "\n").encode())
            for batch in iterator:
                for i, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    out.write((json.dumps({"type": "embedding", "id": i, "embedding": vector}) + "\n").encode())
                    rows += 1
        if rows:
            files.move(hidden, f"{root}/part-{name}")
        else:
            files.delete_file(hidden)
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        """Every part is visible since its task ended."""

    def abort(self, messages: list) -> None:
        """Whole parts stay: the next run goes on from them."""


class EmbeddingProgress(DataSource):
    """Options: path, provider, completedAt, chunkCount."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def progress(spark: SparkSession, path: str, provider: str, completed_at: str, chunk_count: int) -> DataFrame:
    """(id, embedding) of all whole parts that were made for this model and state."""
    spark.dataSource.register(EmbeddingProgress)
    return spark.read.format(NAME).options(path=path, provider=provider, completedAt=completed_at, chunkCount=str(chunk_count)).load().dropDuplicates(["id"])


def reembed(chunks: DataFrame, path: str, provider: str, completed_at: str, embedder: Callable[[list[str]], list[list[float]]], batch: int = 8, part_rows: int = PART_ROWS) -> DataFrame:
    """Chunks with vectors of ``provider``: those that the checkpoint at ``path`` has are
    taken from it, the others are made and added to it, a part for each task. After
    a job that was stopped, the same call goes on with what is left."""
    spark = chunks.sparkSession
    total = chunks.count()
    state = {"path": path, "provider": provider, "completedAt": completed_at, "chunkCount": str(total)}
    done = progress(spark, path, provider, completed_at, total)
    left = sync.pending(chunks, done)
    parts = max(1, -(-left.count() // part_rows))
    made = sync.embed(left.repartition(parts, "id"), embedder, batch)
    made.write.format(NAME).options(**state).mode("append").save()
    return sync.resumed(chunks.drop("embedding").withColumn("embedding", sync.no_vector()), progress(spark, path, provider, completed_at, total))
