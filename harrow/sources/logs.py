"""Request logs and URL lists as data sources of their own: batch and stream read each file once, filters are applied where files are read.

``spark.read.format("request_log").load(folder)`` gives (url, method, status, ts, file, line) of files of JSON lines;
``spark.read.format("url_list")`` gives (url, file, line). A file is a partition. As streams, the offset is the list of
files that were there, in order of name; files that come later belong to later batches, and a restart goes on after those
that were read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from harrow.session import ship


class FilePart(InputPartition):
    def __init__(self, path: str):
        self.path = path


def files(uri: str, ending: str) -> list[str]:
    """Paths below ``uri``, which any executor can open, by name. Hidden ones are left out."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    found = fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
    root = uri if "://" in uri else f"file://{uri}"
    prefix = root[: len(root) - len(path)] if root.endswith(path) else root.split("://")[0] + "://"
    return sorted(prefix + f.path for f in found if f.type == pyarrow.fs.FileType.File and f.base_name.endswith(ending) and not f.base_name.startswith((".", "_")))


def lines(uri: str) -> Iterator[str]:
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path) as stream:
        rest = b""
        while block := stream.read(1 << 20):
            *whole, rest = (rest + block).split(b"\n")
            yield from (x.decode("utf-8", "replace") for x in whole)
        if rest:
            yield rest.decode("utf-8", "replace")


def url_rows(path: str) -> Iterator[tuple]:
    for n, text in enumerate(lines(path)):
        if (url := text.strip()) and not url.startswith("#"):
            yield url, path, n


def log_rows(path: str) -> Iterator[tuple]:
    """Lines that are no JSON objects are rows with a line number only."""
    for n, text in enumerate(lines(path)):
        if not text.strip():
            continue
        try:
            x = json.loads(text)
        except (ValueError, RecursionError):
            x = None
        x = x if isinstance(x, dict) else {}
        status, ts = x.get("status"), x.get("ts")
        kept = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
        yield kept(x.get("url")), kept(x.get("method")), status if type(status) is int and abs(status) < 1 << 63 else None, float(ts) if type(ts) in (int, float) else None, path, n


class _Reader(DataSourceReader):
    def __init__(self, source: FileSource):
        self.source, self.tests = source, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership are tested as lines are read; what else there is Spark tests."""
        names = self.source.schema().names if isinstance(self.source.schema(), StructType) else [c.split()[0] for c in self.source.schema().split(", ")]
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in names:
                self.tests.append((names.index(f.attribute[0]), frozenset(f.value) if isinstance(f, In) else frozenset([f.value])))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [FilePart(p) for p in files(self.source.options["path"], self.source.options.get("ending", self.source.ending))]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        for row in type(self.source).rows(partition.path):
            if all(row[k] in values for k, values in self.tests):
                yield row


class _StreamReader(DataSourceStreamReader):
    def __init__(self, source: FileSource):
        self.source = source

    def initialOffset(self) -> dict:
        return {"files": []}

    def latestOffset(self) -> dict:
        return {"files": files(self.source.options["path"], self.source.options.get("ending", self.source.ending))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        seen = set(start["files"])
        return [FilePart(p) for p in end["files"] if p not in seen]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        yield from type(self.source).rows(partition.path)


class FileSource(DataSource):
    ending = ""

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self)


class RequestLog(FileSource):
    rows, ending = staticmethod(log_rows), ".jsonl"

    @classmethod
    def name(cls) -> str:
        return "request_log"

    def schema(self) -> str:
        return "url string, method string, status long, ts double, file string, line long"


class UrlList(FileSource):
    rows, ending = staticmethod(url_rows), ".txt"

    @classmethod
    def name(cls) -> str:
        return "url_list"

    def schema(self) -> str:
        return "url string, file string, line long"


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (RequestLog, UrlList):
        spark.dataSource.register(source)
