"""A folder into which a live feed lands files of JSON lines, as a streaming source with offsets and replay."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


def _names(path: str, after: str = "", upto: str | None = None) -> list[str]:
    """Names of the landed files behind `after` and up to `upto`, in order."""
    system, root = pafs.FileSystem.from_uri(path)
    found = system.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    names = sorted(f.base_name for f in found if f.type == pafs.FileType.File and f.base_name.endswith(".jsonl"))
    return [n for n in names if n > after and (upto is None or n <= upto)]


class File(InputPartition):
    def __init__(self, name: str):
        self.name = name


def _rows(path: str, name: str, schema: StructType) -> Iterator[tuple]:
    """Rows of one file, fields by name; a line that is no JSON object is skipped, and so is a field of another type."""
    kinds = {"long": int, "integer": int, "double": (int, float), "string": str, "boolean": bool}
    fields = [(f.name, kinds[f.dataType.typeName()], f.dataType.typeName()) for f in schema.fields]
    system, root = pafs.FileSystem.from_uri(path)
    with system.open_input_stream(f"{root}/{name}") as stream:
        for line in stream.read().decode("utf-8", "replace").splitlines():
            try:
                row = json.loads(line)
            except ValueError:
                continue
            if isinstance(row, dict):
                value = lambda n, kind, row=row: x if isinstance(x := row.get(n), kind) and not (isinstance(x, bool) and kind is not bool) else None
                yield tuple(float(v) if t == "double" and (v := value(n, kind)) is not None else value(n, kind) for n, kind, t in fields)


class LandingBatch(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[InputPartition]:
        return [File(n) for n in _names(self.path)]

    def read(self, partition: File) -> Iterator[tuple]:
        return _rows(self.path, partition.name, self.schema)


class LandingStream(DataSourceStreamReader):
    """An offset is the name of the last file taken. Files are written whole, under names that grow, and stay where they are, so any range of offsets can be read again."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema
        self.seen = ""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        names = _names(self.path, self.seen)
        self.seen = names[-1] if names else self.seen
        return {"file": self.seen}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.seen = max(self.seen, end["file"])
        return [File(n) for n in _names(self.path, start["file"], end["file"])]

    def read(self, partition: File) -> Iterator[tuple]:
        return _rows(self.path, partition.name, self.schema)

    def commit(self, end: dict) -> None:
        """Files stay: another query, or this one from an older checkpoint, may read them."""


class Landing(DataSource):
    """spark.readStream.format("landing").schema(...).load(folder): fields are longs, integers, doubles, strings or booleans; a file is a partition."""

    @classmethod
    def name(cls) -> str:
        return "landing"

    def reader(self, schema: StructType) -> DataSourceReader:
        return LandingBatch(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return LandingStream(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Landing)
