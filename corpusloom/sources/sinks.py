"""A sink for records as canonical JSON lines that commits whole batches: a data source for ``df.write``.

``rows.write.format("canonical_records").option("batch", id).mode("append").save(folder)``

Tasks write files of their own below ``parts``; only the commit makes them visible, by one manifest ``_batches/<id>.json``
that names them. A failed write leaves no manifest, and its files are deleted. A batch whose manifest is there already is
not written again, so retries and replays show it once. ``mode("overwrite")`` drops the earlier batches when it commits.
Readers list manifests, never the folder; ``read_batches`` is one. A key's order in a line does not depend on the schema.
The folder must be one that driver and executors share, a path or a URI of a file system that Arrow knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "canonical_records"


def canonical(value) -> str:
    """JSON with sorted keys and no blanks; what JSON has no form for is written as text."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str)


def _plain(value):
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, float) and value != value:
        return None
    return value


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    rows: int


class RecordWriter(DataSourceWriter):
    def __init__(self, folder: str, batch: str, overwrite: bool):
        self.folder, self.batch, self.overwrite, self.run = folder.rstrip("/"), batch, overwrite, uuid.uuid4().hex

    def _manifest(self) -> str:
        return f"_batches/{self.batch}.json"

    def _done(self, store: fs.FileSystem, root: str) -> bool:
        return not self.overwrite and store.get_file_info(f"{root}/{self._manifest()}").type == fs.FileType.File

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = _store(self.folder)
        if self._done(store, root):
            return Written(None, 0)
        store.create_dir(f"{root}/parts/{self.run}", recursive=True)
        name, rows = f"parts/{self.run}/{uuid.uuid4().hex}.jsonl", 0
        with store.open_output_stream(f"{root}/{name}") as out:
            for row in iterator:
                out.write((canonical(_plain(row)) + "\n").encode())
                rows += 1
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.folder)
        if self._done(store, root):
            self.abort(messages)
            return
        store.create_dir(f"{root}/_batches", recursive=True)
        earlier = [f.path for f in store.get_file_info(fs.FileSelector(f"{root}/_batches")) if f.path.endswith(".json")]
        parts = [m for m in messages if m is not None and m.name]
        manifest = {"batch": self.batch, "files": [m.name for m in parts if m.rows], "rows": sum(m.rows for m in parts)}
        hidden = f"{root}/_batches/.{self.run}"
        with store.open_output_stream(hidden) as out:
            out.write(canonical(manifest).encode())
        store.move(hidden, f"{root}/{self._manifest()}")  # the one step that shows the batch
        if self.overwrite:
            for path in earlier:
                if not path.endswith("/" + self._manifest()):
                    store.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.folder)
        if store.get_file_info(f"{root}/parts/{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/parts/{self.run}")


class RecordSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        batch = self.options.get("batch") or uuid.uuid4().hex
        if not all(c.isalnum() or c in "-_." for c in batch) or batch.startswith("."):
            raise ValueError(f"unsafe batch id {batch!r}")
        return RecordWriter(self.options["path"], batch, overwrite)


def append(rows: DataFrame, folder: str, batch: str | None = None, overwrite: bool = False) -> None:
    """Write all rows as one batch. Without an id the batch is a new one."""
    rows.sparkSession.dataSource.register(RecordSink)
    writer = rows.write.format(NAME).mode("overwrite" if overwrite else "append")
    (writer.option("batch", batch) if batch else writer).save(folder)


def manifests(folder: str) -> list[dict]:
    """Batches that are complete, by id: a small file each."""
    store, root = _store(folder.rstrip("/"))
    found = store.get_file_info(fs.FileSelector(f"{root}/_batches", allow_not_found=True))
    names = sorted(f.path for f in found if f.base_name.endswith(".json") and not f.base_name.startswith("."))
    return [json.loads(store.open_input_stream(name).read()) for name in names]


def read_batches(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all complete batches."""
    files = [f"{folder.rstrip('/')}/{name}" for m in manifests(folder) for name in m["files"]]
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(files)
