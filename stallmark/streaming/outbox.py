"""An outbox of messages that a stream fills, each message once.

Tasks write the rows of a batch to files of their own; the driver publishes them by a manifest that carries the batch's
number and takes its name in one rename. Readers see what manifests name, so files of tasks that failed, were repeated or
never got as far as their commit are not there. A batch that comes again after a restart finds its manifest and publishes
nothing. Messages that come again in later batches are held back by keyed state, for as long as the watermark says: the
outbox itself is never read to write to it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from stallmark.streaming.prices import first_within


@dataclass
class Files(WriterCommitMessage):
    names: list[str]
    rows: int


class OutboxWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def _place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        at, root = self._place()
        batches = [b for b in iterator if b.num_rows]
        if not batches:
            return Files([], 0)
        name = f"part-{uuid.uuid4().hex}.parquet"
        at.create_dir(f"{root}/files", recursive=True)
        pq.write_table(pa.Table.from_batches(batches), f"{root}/files/{name}", filesystem=at)
        return Files([name], sum(b.num_rows for b in batches))

    def commit(self, messages: list[Files | None], batchId: int) -> None:
        at, root = self._place()
        at.create_dir(f"{root}/manifests", recursive=True)
        final = f"{root}/manifests/{batchId:012d}.json"
        if at.get_file_info(final).type != fs.FileType.NotFound:  # published before the stream was stopped
            return self.abort(messages, batchId)
        draft = f"{root}/manifests/.{batchId:012d}-{uuid.uuid4().hex}"
        with at.open_output_stream(draft) as out:
            out.write(json.dumps({"batch": batchId, "files": [n for m in messages if m for n in m.names], "rows": sum(m.rows for m in messages if m)}).encode())
        at.move(draft, final)

    def abort(self, messages: list[Files | None], batchId: int) -> None:
        """Deletes files that no manifest will name."""
        at, root = self._place()
        for m in messages:
            for name in m.names if m else []:
                if at.get_file_info(f"{root}/files/{name}").type != fs.FileType.NotFound:
                    at.delete_file(f"{root}/files/{name}")


class Outbox(DataSource):
    """Format `outbox`, a sink of streams: option path, a folder that the driver and all executors reach."""

    @classmethod
    def name(cls) -> str:
        return "outbox"

    def streamWriter(self, schema: StructType, overwrite: bool) -> OutboxWriter:
        return OutboxWriter(self.options["path"])


def fill_outbox(messages: DataFrame, path: str, checkpoint: str, key: str, at: str, keep: str) -> StreamingQuery:
    """Sends each message of a stream to the outbox once, by key: what repeats a key within `keep` of event time `at` is left
    out. One message of a batch must fit a task's memory with its neighbours; batches are Spark's."""
    messages.sparkSession.dataSource.register(Outbox)
    rows = first_within(messages, [key], at, keep)
    return rows.writeStream.format("outbox").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_outbox(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The published messages."""
    place, root = fs.FileSystem.from_uri(path)
    names = []
    for info in place.get_file_info(fs.FileSelector(f"{root}/manifests", allow_not_found=True)):
        if info.extension == "json" and not info.base_name.startswith("."):
            with place.open_input_stream(info.path) as f:
                names += json.loads(f.read())["files"]
    return spark.read.schema(schema).parquet(*(f"{path}/files/{n}" for n in names)) if names else spark.createDataFrame([], schema)
