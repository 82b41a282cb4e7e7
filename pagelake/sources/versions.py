"""Numbered versions of a table, each one small manifest that names what the table is made of.

Data goes into fresh folders first. A version then appears by one rename that fails if the
number is taken, so readers see a version whole or not at all, a writer that dies leaves the
table as it was, and of two writers one is told to look again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has taken the version number."""


class Versions:
    """The manifests below one folder; version 0 is the table before its first commit."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.place = spark, root, f"{root}/_versions"

    def numbers(self) -> list[int]:
        fs, where = hadoop_fs(self.spark, self.place)
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def latest(self) -> tuple[int, dict]:
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, {})

    def read(self, number: int) -> dict:
        if number == 0:
            return {}
        fs, where = hadoop_fs(self.spark, self._file(number))
        stream = fs.open(where)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, after: int, manifest: dict) -> int:
        """Make ``manifest`` the version after ``after``; ``Conflict`` if there is one already."""
        jvm = self.spark.sparkContext._jvm
        draft = f"{self.place}/.draft-{uuid.uuid4().hex}"
        fs, where = hadoop_fs(self.spark, draft)
        out = fs.create(where, False)
        out.write(bytearray(json.dumps(manifest, ensure_ascii=False).encode()))
        out.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        target = jvm.org.apache.hadoop.fs.Path(self._file(after + 1))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(where, target, options)
        except Py4JJavaError as error:
            fs.delete(where, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise Conflict(f"version {after + 1} of {self.root} exists") from error
            raise
        return after + 1

    def change(self, make: Callable[[int, dict], dict | None], tries: int = 8) -> int:
        """Commit what ``make`` builds on the latest version, again after a conflict; None commits nothing."""
        for _ in range(tries - 1):
            try:
                return self._once(make)
            except Conflict:
                continue
        return self._once(make)

    def _once(self, make: Callable[[int, dict], dict | None]) -> int:
        number, manifest = self.latest()
        new = make(number, manifest)
        return number if new is None else self.commit(number, new)

    def expire(self, keep: int) -> list[dict]:
        """Forget all but the last ``keep`` versions; returns the manifests that stay."""
        numbers = self.numbers()
        for old in numbers[:-keep]:
            fs, where = hadoop_fs(self.spark, self._file(old))
            fs.delete(where, False)
        return [self.read(n) for n in numbers[-keep:]]

    def _file(self, number: int) -> str:
        return f"{self.place}/{number:012d}.json"


def hadoop_fs(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = hadoop_fs(spark, path)
    return bool(fs.exists(where))


def remove(spark: SparkSession, path: str) -> bool:
    fs, where = hadoop_fs(spark, path)
    return bool(fs.delete(where, True))


def names_in(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """Names in a folder and whether each is a folder; empty where there is none."""
    fs, where = hadoop_fs(spark, path)
    return [(s.getPath().getName(), bool(s.isDirectory())) for s in fs.listStatus(where)] if fs.exists(where) else []
