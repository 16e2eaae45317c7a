"""Datasets of Arrow stream files with a description of their own, as a Spark data source.

A dataset directory holds ``state.json``, which names its data files, and those
files; a directory of splits holds ``dataset_dict.json`` and a dataset directory
per split. Only what the description names is read.

A file in Arrow's stream format has no index, but each message says how long it
is. A partition is a range of a file's bytes: its task steps from header to
header, without the bodies between, and reads the record batches that begin in
its range. So one file feeds many tasks and nothing is planned beyond names and
sizes. Rows leave as Arrow batches; with ``columns``, the other columns are not
decoded.

Paths are those of pyarrow's file systems (local or shared folders, S3, GCS, HDFS).
"""

from __future__ import annotations

import json
import math
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

# Fixed values of the format.
SPLITS_FILE, STATE_FILE, INFO_FILE = "dataset_dict.json", "state.json", "dataset_info.json"
CONTINUES, END_OF_STREAM = 0xFFFFFFFF, b"\xff\xff\xff\xff\x00\x00\x00\x00"
SCHEMA_MESSAGE, DICTIONARY_MESSAGE, BATCH_MESSAGE = 1, 2, 3

RANGE_BYTES = 128 << 20
ROWS = 1000  # of a batch that is written


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a location; a scheme may be followed by one slash or three."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path.rstrip("/")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.strip("/")
    found, inner = fs.FileSystem.from_uri(path)
    return found, inner.rstrip("/")


def _exists(system: fs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type != fs.FileType.NotFound


def _json(system: fs.FileSystem, path: str) -> dict:
    with system.open_input_stream(path) as file:
        return json.loads(file.read())


def splits_of(path: str) -> list[str] | None:
    """Names of a directory's splits; None for a single dataset, an error for neither."""
    system, root = locate(path)
    if _exists(system, f"{root}/{SPLITS_FILE}"):
        return _json(system, f"{root}/{SPLITS_FILE}")["splits"]
    if _exists(system, f"{root}/{STATE_FILE}"):
        return None
    raise FileNotFoundError(f"no Arrow dataset in {path}")


def split_path(path: str, split: str | None) -> str:
    """Directory of a split; a single dataset is all there is, whatever is asked for."""
    names = splits_of(path)
    if names is None:
        return path
    if split not in names:
        raise ValueError(f"{path} has the splits {', '.join(names)} and not {split}")
    return f"{path.rstrip('/')}/{split}"


def data_files(path: str) -> list[str]:
    """Paths of a dataset's files, as its description names them."""
    system, root = locate(path)
    return [f"{root}/{entry['filename']}" for entry in _json(system, f"{root}/{STATE_FILE}")["_data_files"]]


@dataclass(frozen=True)
class Message:
    at: int
    kind: int
    header: int  # bytes
    body: int  # bytes

    @property
    def end(self) -> int:
        return self.at + self.header + self.body


def _kind_and_body(metadata: bytes) -> tuple[int, int]:
    """Two fields of a message's table: the type of its header and the length of its body."""
    (table,) = struct.unpack_from("<I", metadata, 0)
    fields = table - struct.unpack_from("<i", metadata, table)[0]
    (size,) = struct.unpack_from("<H", metadata, fields)

    def place(field: int) -> int:
        entry = 4 + 2 * field
        offset = struct.unpack_from("<H", metadata, fields + entry)[0] if entry < size else 0
        return offset and table + offset

    kind, body = place(1), place(3)
    return metadata[kind] if kind else 0, struct.unpack_from("<q", metadata, body)[0] if body else 0


def messages(file: pa.NativeFile, size: int) -> Iterator[Message]:
    """A stream's messages, by their headers alone."""
    at = 0
    while at + 4 <= size:
        mark, length = struct.unpack("<Ii", (file.read_at(8, at) + b"\0" * 4)[:8])
        prefix = 8
        if mark != CONTINUES:  # as streams began before version 0.15
            prefix, length = 4, mark
        if length == 0:
            return
        kind, body = _kind_and_body(file.read_at(length, at + prefix))
        message = Message(at, kind, prefix + length, body)
        yield message
        at = message.end


def spark_type(kind: pa.DataType) -> pa.DataType:
    """The Arrow type that Spark has for a type: wider where it has no such type."""
    wider = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0)}
    if kind in wider:
        return wider[kind]
    if pa.types.is_float16(kind):
        return pa.float32()
    if pa.types.is_null(kind) or pa.types.is_large_string(kind) or pa.types.is_string_view(kind):
        return pa.string()
    if pa.types.is_large_binary(kind) or pa.types.is_fixed_size_binary(kind):
        return pa.binary()
    if pa.types.is_dictionary(kind):
        return spark_type(kind.value_type)
    if pa.types.is_timestamp(kind):
        return pa.timestamp("us", tz=kind.tz)
    if pa.types.is_date64(kind):
        return pa.date32()
    if pa.types.is_list(kind) or pa.types.is_large_list(kind) or pa.types.is_fixed_size_list(kind):
        return pa.list_(spark_type(kind.value_type))
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, spark_type(f.type)) for f in kind])
    if pa.types.is_map(kind):
        return pa.map_(spark_type(kind.key_type), spark_type(kind.item_type))
    return kind


def _file_schema(path: str) -> pa.Schema:
    files = data_files(path)
    if not files:
        raise ValueError(f"the description of {path} names no data files")
    system, _ = locate(path)
    with system.open_input_stream(files[0]) as file:
        return pa.ipc.open_stream(file).schema


def _picked(options: dict) -> list[str] | None:
    return json.loads(options["columns"]) if options.get("columns") else None


@dataclass
class FileRange(InputPartition):
    file: str
    size: int
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, columns: list[str] | None, range_bytes: int):
        self.path, self.schema, self.columns, self.range_bytes = path, schema, columns, range_bytes

    def partitions(self) -> list[FileRange]:
        system, _ = locate(self.path)
        found = []
        for info in system.get_file_info(data_files(self.path)):
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(f"{self.path} names {info.path}, which is not there")
            parts = max(1, math.ceil(info.size / self.range_bytes))
            cuts = [info.size * i // parts for i in range(parts + 1)]
            found += [FileRange(info.path, info.size, a, b) for a, b in zip(cuts, cuts[1:])]
        return found

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        system, _ = locate(self.path)
        target = to_arrow_schema(self.schema)
        with system.open_input_file(partition.file) as file:
            head: list[bytes] = []  # the schema and the dictionaries so far
            for message in messages(file, partition.size):
                if message.kind == BATCH_MESSAGE:
                    if message.at >= partition.end:
                        return
                    if message.at < partition.start:
                        continue
                raw = file.read_at(message.end - message.at, message.at)
                if message.kind != BATCH_MESSAGE:
                    head.append(raw)
                    continue
                yield from self._decoded(b"".join([*head, raw, END_OF_STREAM]), target)

    def _decoded(self, stream: bytes, target: pa.Schema) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcReadOptions()
        if self.columns:
            with pa.ipc.open_stream(pa.py_buffer(stream)) as whole:
                options = pa.ipc.IpcReadOptions(included_fields=[whole.schema.get_field_index(c) for c in self.columns])
        with pa.ipc.open_stream(pa.py_buffer(stream), options=options) as reader:
            for batch in reader:
                columns = [batch.column(name) for name in target.names]
                plain = [c.dictionary_decode() if pa.types.is_dictionary(c.type) else c for c in columns]
                cast = [c.cast(kind) for c, kind in zip(plain, target.types)]
                yield pa.RecordBatch.from_arrays(cast, schema=target)


def _feature(kind: pa.DataType) -> object:
    """A type as the description's features write it."""
    if pa.types.is_struct(kind):
        return {f.name: _feature(f.type) for f in kind}
    if pa.types.is_list(kind):
        return {"feature": _feature(kind.value_type), "_type": "Sequence"}
    names = {pa.float64(): "float64", pa.float32(): "float32", pa.date32(): "date32"}
    return {"dtype": names.get(kind, str(kind)), "_type": "Value"}


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int
    bytes: int


class _Writer(DataSourceArrowWriter):
    """Each task writes a file of its own name; only those of tasks that succeeded are in the description."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = locate(self.path)
        system.create_dir(root, recursive=True)
        name, target, rows = f"data-{uuid.uuid4().hex}.arrow", to_arrow_schema(self.schema), 0
        with system.open_output_stream(f"{root}/{name}") as out, pa.ipc.new_stream(out, target) as stream:
            for batch in iterator:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    cast = [c.cast(kind) for c, kind in zip(part.columns, target.types)]
                    stream.write_batch(pa.RecordBatch.from_arrays(cast, schema=target))
                rows += batch.num_rows
        return Written(name, rows, system.get_file_info(f"{root}/{name}").size)

    def commit(self, messages: Sequence[Written | None]) -> None:
        system, root = locate(self.path)
        done = [m for m in messages if m is not None]
        state = {
            "_data_files": [{"filename": m.file} for m in done],
            "_fingerprint": uuid.uuid4().hex[:16],
            "_format_columns": None,
            "_format_kwargs": {},
            "_format_type": None,
            "_output_all_columns": False,
            "_split": root.rsplit("/", 1)[-1],
        }
        schema = to_arrow_schema(self.schema)
        info = {"description": "", "features": {f.name: _feature(f.type) for f in schema}}
        info["splits"] = {state["_split"]: {"num_examples": sum(m.rows for m in done), "num_bytes": sum(m.bytes for m in done)}}
        for file, content in ((INFO_FILE, info), (STATE_FILE, state)):
            with system.open_output_stream(f"{root}/{file}") as out:
                out.write(json.dumps(content, indent=2).encode())

    def abort(self, messages: Sequence[Written | None]) -> None:
        system, root = locate(self.path)
        for message in messages:
            if message is not None:
                system.delete_file(f"{root}/{message.file}")


class ArrowDataset(DataSource):
    """Options: ``path`` (of one dataset), ``columns`` (a JSON list), ``range_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "arrow_dataset"

    def schema(self) -> StructType:
        own = _file_schema(self.options["path"])
        picked = _picked(self.options) or own.names
        return from_arrow_schema(pa.schema([pa.field(n, spark_type(own.field(n).type)) for n in picked]))

    def reader(self, schema: StructType) -> _Reader:
        size = int(self.options.get("range_bytes", RANGE_BYTES))
        return _Reader(self.options["path"], schema, _picked(self.options), size)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema)


def read_arrow(
    spark: SparkSession,
    path: str,
    split: str | None = None,
    columns: Sequence[str] | None = None,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """A dataset, or a split of a directory of splits; a split that is not there is an error."""
    spark.dataSource.register(ArrowDataset)
    reader = spark.read.format("arrow_dataset").option("range_bytes", str(range_bytes))
    if columns is not None:
        reader = reader.option("columns", json.dumps(list(columns)))
    return reader.load(split_path(path, split))


def write_arrow(df: DataFrame, path: str) -> None:
    """Write one dataset: a file per task, and the description once all are there."""
    system, root = locate(path)
    if _exists(system, f"{root}/{STATE_FILE}"):
        raise FileExistsError(f"{path} has a dataset already")
    df.sparkSession.dataSource.register(ArrowDataset)
    df.write.format("arrow_dataset").mode("append").save(path)


def write_arrow_splits(splits: dict[str, DataFrame], path: str) -> None:
    """Write a directory of splits."""
    for name, df in splits.items():
        write_arrow(df, f"{path.rstrip('/')}/{name}")
    system, root = locate(path)
    with system.open_output_stream(f"{root}/{SPLITS_FILE}") as out:
        out.write(json.dumps({"splits": list(splits)}).encode())
