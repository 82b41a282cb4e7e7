"""An endless seed list as a stream: files of lines in a folder, which others go on appending to.

Spark's own file stream takes a file once and never sees what is appended to it. Here the offset
is the number of bytes taken of every file, up to the end of its last whole line, so each line
comes once, after a restart too.  Ranges are cut into parts of bounded size, and a line belongs to
the part that it starts in.  Files may be added and may grow; they must not shrink or be renamed.
"""

from __future__ import annotations

import io
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "seed string, file string, at bigint"
CHUNK = 1 << 20


class Part(InputPartition):
    """Bytes ``start`` to ``end`` of a file whose new range begins at ``first``; both ends of that range are line ends."""

    def __init__(self, file: str, first: int, start: int, end: int):
        self.file, self.first, self.start, self.end = file, first, start, end


def last_line_end(files: fs.FileSystem, path: str, low: int, size: int) -> int:
    """Where the last whole line of a file ends; ``low`` if there is none after it."""
    with files.open_input_file(path) as source:
        end = size
        while end > low:
            start = max(low, end - CHUNK)
            found = source.read_at(end - start, start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            end = start
    return low


def lines_of(files: fs.FileSystem, part: Part) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that start in a part."""
    with files.open_input_file(part.file) as raw, io.BufferedReader(raw, CHUNK) as source:
        at = part.start
        if at > part.first:
            # From the byte before, to know whether a line starts at the very first one.
            source.seek(at - 1)
            at += len(source.readline()) - 1
        else:
            source.seek(at)
        while at < part.end:
            line = source.readline()
            yield at, line
            at += len(line)


class SeedReader(DataSourceStreamReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes, self.known = path, part_bytes, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, root = fs.FileSystem.from_uri(self.path)
        for info in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.is_file and info.size and not info.base_name.startswith((".", "_")):
                before = self.known.get(info.path, 0)
                if info.size > before:
                    self.known[info.path] = last_line_end(files, info.path, before, info.size)
        return {path: end for path, end in self.known.items() if end}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [
            Part(path, start.get(path, 0), low, min(low + self.part_bytes, last))
            for path, last in sorted(end.items())
            for low in range(start.get(path, 0), last, self.part_bytes)
        ]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(self.path)
        schema = pa.schema([("seed", pa.string()), ("file", pa.string()), ("at", pa.int64())])
        seeds, places = [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"seed": seeds, "file": [partition.file] * len(seeds), "at": places}, schema=schema)

        for at, line in lines_of(files, partition):
            seed = line.decode("utf-8", "replace").strip()
            if seed:
                seeds.append(seed)
                places.append(at)
            if len(seeds) == 10_000:
                yield batch()
                seeds, places = [], []
        if seeds:
            yield batch()


class SeedSource(DataSource):
    """Options: ``path`` of the folder, a URI where it is not local, and ``partBytes``."""

    @classmethod
    def name(cls) -> str:
        return "seeds"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> SeedReader:
        path = self.options["path"]
        part_bytes = int(self.options.get("partBytes", 16 << 20))
        if part_bytes < 1:
            raise ValueError("partBytes is at least 1")
        return SeedReader(path if "://" in path or path.startswith("/") else path.removeprefix("file:"), part_bytes)


# Spark also makes the reader in a Python process on the driver, which has none of the shipped files.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stream_seeds(spark: SparkSession, path: str, part_bytes: int = 16 << 20) -> DataFrame:
    """(seed, file, at): the lines of the files in a folder as they are appended, blank ones left out.

    ``at`` is the byte a line starts at.  A line counts once it ends with a newline.
    """
    spark.dataSource.register(SeedSource)
    return spark.readStream.format("seeds").option("partBytes", part_bytes).load(path)
