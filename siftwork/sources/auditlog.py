"""An audit log that holds each batch once: df.write.format("audit"), stream.writeStream.format("audit"), spark.read.format("audit").

Tasks write Parquet files into the folder data; a batch counts once its commit, a file in the folder log that names its files, is there. Commits are put in place by renaming, which
either happens or doesn't, and are named by writer and batch: a batch that is written again after a failure finds its commit and gives its files up. Files that no commit names are never
read. Nothing that is there is rewritten.

Options: path; writer, the name of who writes (streams and batches of one name share numbers); batchId for a batch write, without which each write is a batch of its own. Paths are local or of a
store that pyarrow.fs reaches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .pagesource import store_of


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


@dataclass
class Files(InputPartition):
    files: list[str]


class _Log:
    def __init__(self, schema: StructType, options):
        self.schema, self.path, self.writer = schema, options.get("path"), options.get("writer", "audit")
        if not self.path:
            raise ValueError("no path")

    def _at(self) -> tuple[pafs.FileSystem, str]:
        store, top = store_of(self.path)
        return store, top.rstrip("/")

    def put(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """One task's rows as a file that nothing names yet."""
        store, top = self._at()
        store.create_dir(f"{top}/data", recursive=True)
        name, rows, out, arrow = f"{uuid.uuid4().hex}.parquet", 0, None, to_arrow_schema(self.schema)
        for batch in batches:
            if batch.num_rows:
                out = out or pq.ParquetWriter(store.open_output_stream(f"{top}/data/{name}"), arrow)
                out.write_batch(pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(batch.columns, arrow, strict=True)], schema=arrow))
                rows += batch.num_rows
        if out:
            out.close()
        return Written(name if out else None, rows)

    def seal(self, messages: list[Written | None], batch: str) -> bool:
        """Name the batch's files, unless that has been done: then the new ones go."""
        store, top = self._at()
        store.create_dir(f"{top}/log", recursive=True)
        commit = f"{top}/log/{self.writer}-{batch}.json"
        if store.get_file_info(commit).type != pafs.FileType.NotFound:
            self.drop(messages)
            return False
        draft = f"{top}/log/_{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as f:
            f.write(json.dumps({"writer": self.writer, "batch": batch, "files": [m.file for m in messages if m and m.file], "rows": sum(m.rows for m in messages if m)}).encode())
        store.move(draft, commit)
        return True

    def drop(self, messages: list[Written | None]) -> None:
        store, top = self._at()
        for m in messages:
            if m and m.file and store.get_file_info(f"{top}/data/{m.file}").type != pafs.FileType.NotFound:
                store.delete_file(f"{top}/data/{m.file}")

    def commits(self) -> list[dict]:
        store, top = self._at()
        found = store.get_file_info(pafs.FileSelector(f"{top}/log", allow_not_found=True))
        out = []
        for path in sorted(i.path for i in found if i.path.endswith(".json")):
            with store.open_input_stream(path) as f:
                out.append(json.loads(f.read()))
        return out


class _BatchWriter(DataSourceArrowWriter):
    def __init__(self, log: _Log, batch: str):
        self.log, self.batch = log, batch

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.log.put(iterator)

    def commit(self, messages) -> None:
        self.log.seal(messages, self.batch)

    def abort(self, messages) -> None:
        self.log.drop(messages)


class _StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, log: _Log):
        self.log = log

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.log.put(iterator)

    def commit(self, messages, batchId: int) -> None:
        self.log.seal(messages, str(batchId))

    def abort(self, messages, batchId: int) -> None:
        self.log.drop(messages)


class _Reader(DataSourceReader):
    def __init__(self, log: _Log):
        self.log, self.names = log, log.schema.names

    def partitions(self) -> list[Files]:
        files = [f for c in self.log.commits() for f in c["files"]]
        return [Files(files[at : at + 16]) for at in range(0, len(files), 16)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, top = self.log._at()
        arrow = to_arrow_schema(self.log.schema)
        for name in partition.files:
            with store.open_input_file(f"{top}/data/{name}") as f:
                for batch in pq.ParquetFile(f).iter_batches(columns=self.names):
                    yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(n)).cast(t.type) for n, t in zip(self.names, arrow, strict=True)], schema=arrow)


class AuditLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "audit"

    def schema(self) -> StructType:
        raise ValueError("say which columns to read: spark.read.format('audit').schema(...)")

    def writer(self, schema: StructType, overwrite: bool) -> _BatchWriter:
        if overwrite:
            raise ValueError("an audit log isn't overwritten; use mode append")
        return _BatchWriter(_Log(schema, self.options), self.options.get("batchId", uuid.uuid4().hex))

    def streamWriter(self, schema: StructType, overwrite: bool) -> _StreamWriter:
        return _StreamWriter(_Log(schema, self.options))

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(_Log(schema, self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AuditLog)
