"""Event lines that arrive as files, each line with its place: a streaming source for Spark.

Where a file source gives all lines of a file the same time, this one numbers files in their order and lines in
theirs, so that of equal measurements the first one is known, however files are dealt over tasks and batches, and
after a restart.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..shared import ship_package

SCHEMA = "line string, ordinal long"
LINES = 1 << 32


class FilePart(InputPartition):
    def __init__(self, path: str, number: int):
        super().__init__((path, number))


class FeedReader(DataSourceStreamReader):
    """An offset is how many files there are and the key of the last one; files that sort behind it are new.

    Keys are names, or with ``order`` = time the times of files and then names. A file must be complete when it appears
    (moved into the folder, as writers do), stay there, and sort behind those before it.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.by_time = options["path"].rstrip("/"), options.get("order", "name") == "time"

    def _store(self) -> tuple:
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def _files(self) -> list[tuple[str, str]]:
        """(key, path) in order."""
        from pyarrow import fs

        store, at = self._store()
        found = [f for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
        return sorted((f"{f.mtime_ns:020d} {f.base_name}" if self.by_time else f.base_name, f.path) for f in found)

    def initialOffset(self) -> dict:
        return {"files": 0, "last": ""}

    def latestOffset(self) -> dict:
        found = self._files()
        return {"files": len(found), "last": found[-1][0]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[FilePart]:
        new = [path for key, path in self._files() if start["last"] < key <= end["last"]]
        return [FilePart(path, start["files"] + i) for i, path in enumerate(new)]

    def read(self, part: FilePart) -> Iterator[tuple[str, int]]:
        path, number = part.value
        with self._store()[0].open_input_stream(path) as stream:
            for i, line in enumerate(io.TextIOWrapper(stream, encoding="utf-8", errors="replace", newline="\n")):
                yield line.rstrip("\r\n"), number * LINES + i


class SweepFeed(DataSource):
    """Options: ``path``, and ``order`` (name or time)."""

    @classmethod
    def name(cls) -> str:
        return "rf_sweep_feed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FeedReader:
        return FeedReader(self.options)


def read_feed(spark: SparkSession, path: str, order: str = "name") -> DataFrame:
    """A stream of (line, ordinal): lines of the folder's files, in order of files and of lines."""
    ship_package(spark)
    spark.dataSource.register(SweepFeed)
    return spark.readStream.format("rf_sweep_feed").option("path", path).option("order", order).load()
