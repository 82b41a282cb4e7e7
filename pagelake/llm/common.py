"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.session import give_back, shared_dir
from pagelake.sources.bucketed import read_bucketed, write_bucketed
from pagelake.sources.versions import remove

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array: every input bit reaches every output bit."""
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def text_column(df: DataFrame, name: str) -> Column:
    """The text of a row, a null text as the empty one."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, nulls as empty."""
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], column: str, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts together hold ``size`` bytes or so, and one row at least.

    What a task builds from a block is then bounded, whatever the batches hold.  What Arrow has
    freed goes back to the system after each batch; a worker that waits for tasks would keep it.
    """
    for batch in batches:
        total = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = int(total[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + size, "right")))
            yield batch.slice(start, end - start)
            start = end
        del batch
        pa.default_memory_pool().release_unused()


def coded_parts(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The parts of texts between ASCII white space: the distinct ones, a number for each part, and the texts' bounds.

    White space at an edge leaves an empty part; memory follows the size of all texts together.
    """
    # Taken, as Arrow's string functions misread slices of large arrays.
    texts = texts.cast(pa.large_string()).fill_null("").take(pa.array(np.arange(len(texts))))
    parts = pc.ascii_split_whitespace(texts)
    coded = parts.flatten().dictionary_encode()
    bounds = np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy())]).astype(np.int64)
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), bounds


def per_batch(
    make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: pa.Schema
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow``: ``make`` builds the task's state, its result handles a batch.

    ``maxBytesPerBatch`` bounds what a batch holds, so a task's memory does not follow
    its partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle = make()
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                out = handle(batch.slice(start, 2000))
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


class Memo:
    """A bounded cache in two generations: what was not asked for lately goes first."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, keys: set) -> list:
        """Keys not known yet; known ones are kept in the young generation."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        young, old, new = self.young, self.old, []
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    new.append(k)
        return new


def check_remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo a number; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % divisor


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session that holds meanwhile, and is put back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager:
    """What is written meanwhile leaves no shuffle files behind, which else stay until the driver collects its garbage."""
    return setting(spark, _CLEANUP, "true")


def small_batches(spark: SparkSession) -> AbstractContextManager:
    """What runs meanwhile hands rows to Python in batches of 4 MB or so, and of one row at least.

    A task holds a batch several times, in the executor's buffers and in its worker.
    """
    return setting(spark, _BATCH, f"{4 << 20}b")


def kept(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder as Parquet and read again.

    Like a checkpoint this cuts the lineage where every executor can read; it is compressed,
    and Spark knows its size when it plans the joins that follow. Nothing reads the shuffles
    of the write again, so they go at its end, and the driver gives back what its plan took:
    operators keep tables by the dozen.
    """
    place = f"{shared_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(place)
    give_back(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(place)
    out.kept_at = place
    return out


def kept_by(df: DataFrame, key: str) -> DataFrame:
    """Like ``kept``, in as many hash buckets of a key as shuffles have parts: joins on the key leave these rows where they are."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        write_bucketed(df.repartition(buckets, key), place, [key], buckets)
    give_back(spark)
    out = read_bucketed(spark, place, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), [key], buckets)
    out.kept_at = place
    return out


def forget(*tables: DataFrame) -> None:
    """Drop the files of kept tables from which nothing is to be read any more."""
    for table in tables:
        remove(table.sparkSession, table.kept_at)
