"""Line dedup over levelled sorted runs of line hashes.

A store of runs holds the 128-bit hashes of all line keys seen so far. A run is a folder in
hash buckets, sorted inside each; runs share no key. A new batch groups its own keys (partial
results first), then meets the runs one after the other in merge joins in which only the batch
is shuffled, and adds what no run holds as a run of level 0. Whenever ``fanout`` runs of a
level have gathered they are compacted into one of the next, so a store of n batches is read
as at most ``fanout * log(n)`` runs. A manifest names the live runs: a batch that dies
half-way leaves the store as it was.

A line's key is the line without ASCII white space at both ends and with A-Z lower-cased.
Keys of ``least`` code points or more that an earlier batch held, or a smaller id of the same
batch, lose their lines; lines that repeat inside one document only stay. With batches in
ascending order of ids, as ``drop_repeated`` cuts them, every line stays in the smallest id
that holds it.

A null text counts as empty: one empty line. Rows that share an id are one document: none takes
a line from another, each loses its own. All rows with a null id are one document, after all
others. Equal rows get equal results. Repeated positions go back by (id, hash of the text),
so a line in a third of all documents is a hot key in one join only, against a shuffled side
that adaptive execution splits. No white space but the six ASCII ones is stripped. An empty
table gives no rows. Only SQL functions are used.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm.columns import LOWER, UPPER
from pagelake.llm.common import text_column
from pagelake.session import shared_dir
from pagelake.sources.bucketed import read_bucketed, write_bucketed
from pagelake.sources.versions import Versions, names_in, remove

BLANK = " \t\n\x0b\x0c\r"
KEY = ["h", "g"]
SCHEMA = "h bigint, g bigint, first_doc string, several boolean, old boolean"


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def folded(text: Column) -> Column:
    """A-Z lower-cased. Spark's own lower-casing is faster and right where all is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_keys(docs: DataFrame, id_col: str, text: str, least: int) -> DataFrame:
    """``(doc, w, at, h, g)``: hashes of the lines' keys of ``least`` code points or more, with their positions."""
    whole = docs.select(F.col(id_col).alias("doc"), text_column(docs, text).alias("text"))
    each = whole.select("doc", F.xxhash64("text").alias("w"), F.posexplode(lines(folded(F.col("text")))).alias("at", "line"))
    keys = each.select("doc", "w", "at", F.btrim("line", F.lit(BLANK)).alias("key")).where(F.length("key") >= least)
    return keys.select("doc", "w", "at", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"))


class LineRuns:
    """The runs below one folder that every executor can reach."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 3, least: int = 10):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.path, self.fanout, self.least = spark, path, fanout, least
        self.versions = Versions(spark, path)
        # As many buckets as shuffles have, so that a grouping lands where the runs lie.
        self.buckets = self.versions.latest()[1].get("buckets") or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(self) -> list[dict]:
        """Live runs, ``{"name", "level"}``, oldest first."""
        return self.versions.latest()[1].get("runs", [])

    def _run(self, name: str) -> DataFrame:
        """The keys of a run; those that an older one holds are in its files, but not in the run."""
        return read_bucketed(self.spark, f"{self.path}/{name}", SCHEMA, KEY, self.buckets).where("not old")

    def add(self, batch: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """Add a batch; returns ``(doc, w, gone)``, the positions of repeated lines by id and hash of the text."""
        number, manifest = self.versions.latest()
        runs, part = manifest.get("runs", []), f"{number:06d}-{uuid.uuid4().hex[:12]}"
        doc_type = batch.schema[id_col].dataType
        keys_at, run = f"{self.path}/lines-{part}", f"run-{part}"
        line_keys(batch, id_col, text, self.least).write.parquet(keys_at)
        held = self.spark.read.schema(f"doc {doc_type.simpleString()}, w bigint, at int, h bigint, g bigint").parquet(keys_at)

        without_id = F.bool_or(F.col("doc").isNull())
        mixed = (F.min("doc") < F.max("doc")) | (without_id & F.min("doc").isNotNull())
        own = held.groupBy(*KEY).agg(F.min("doc").cast("string").alias("first_doc"), F.coalesce(mixed, F.lit(False)).alias("several"))
        known: list[Column] = []
        for k, older in enumerate(runs):
            flag = f"in{k}"
            own = own.join(self._run(older["name"]).select(*KEY, F.lit(True).alias(flag)), KEY, "left")
            known.append(F.col(flag).isNotNull())
        old = reduce(lambda a, b: a | b, known, F.lit(False))
        write_bucketed(own.select(*KEY, "first_doc", "several", old.alias("old")), f"{self.path}/{run}", KEY, self.buckets)

        # Read without its buckets: both sides of this join are shuffled, and a hot line can be split.
        repeated = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{run}").where("old or several")
        lost = F.col("old") | ~F.col("doc").eqNullSafe(F.col("first_doc").cast(doc_type))
        gone = held.join(repeated, KEY).where(lost).groupBy("doc", "w").agg(F.sort_array(F.collect_set("at")).alias("gone"))
        gone.write.parquet(f"{self.path}/gone-{part}")
        remove(self.spark, keys_at)

        runs = self._compacted([*runs, {"name": run, "level": 0}])
        self.versions.commit(number, {"buckets": self.buckets, "runs": runs})
        return self.spark.read.schema(gone.schema).parquet(f"{self.path}/gone-{part}")

    def _compacted(self, runs: list[dict]) -> list[dict]:
        """Merge the runs of a level into one of the next wherever ``fanout`` have gathered."""
        level = 0
        while level <= max(r["level"] for r in runs):
            full = [r for r in runs if r["level"] == level]
            if len(full) >= self.fanout:
                name = f"run-{uuid.uuid4().hex[:12]}"
                rows = reduce(DataFrame.unionByName, [self._run(r["name"]) for r in full])
                write_bucketed(rows.repartition(self.buckets, *KEY), f"{self.path}/{name}", KEY, self.buckets)
                runs = [{"name": name, "level": level + 1}, *[r for r in runs if r["level"] != level]]
            level += 1
        return runs

    def vacuum(self) -> None:
        """Drop the files of runs that have been merged; to be run while nothing reads them."""
        live = {r["name"] for r in self.runs()}
        for name, _ in names_in(self.spark, self.path):
            if name.startswith("run-") and name not in live:
                remove(self.spark, f"{self.path}/{name}")


def without(text: Column, lines_of: Column, gone: Column) -> Column:
    """The text without the lines at some sorted positions: the stretches between them, joined again."""

    def between(i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(F.get(gone, i - 1) + 1)
        return F.slice(lines_of, start + 1, F.coalesce(F.get(gone, i), F.size(lines_of)) - start)

    stretches = F.transform(F.sequence(F.lit(0), F.size(gone)), between)
    return F.when(gone.isNull(), text).otherwise(F.array_join(F.flatten(stretches), "\n"))


def batches_by_id(docs: DataFrame, id_col: str, n: int) -> list[DataFrame]:
    """The rows in ``n`` ranges of about equal size, in ascending order of numeric ids; null ids come last."""
    shares = [k / n for k in range(1, n)]
    cuts = docs.agg(F.percentile_approx(id_col, shares).alias("c")).first()["c"] if shares else None
    cuts = sorted(set(cuts or []))
    if not cuts:
        return [docs]
    column = F.col(id_col)
    inner = [docs.where((column > a) & (column <= b)) for a, b in zip(cuts, cuts[1:])]
    return [docs.where(column <= cuts[0]), *inner, docs.where((column > cuts[-1]) | column.isNull())]


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", batches: int = 4, fanout: int = 3,
                  least: int = 10, store: LineRuns | None = None) -> DataFrame:
    """``(id, kept, n_lines, n_dropped)`` for every row: its text without the lines that smaller ids hold.

    The table goes through the runs in ``batches`` ranges of ids; a ``store`` that has seen
    earlier tables can be given, and what it holds is repeated here.
    """
    spark = docs.sparkSession
    runs = store or LineRuns(spark, f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}", fanout, least)
    found = reduce(DataFrame.unionByName, [runs.add(part, id_col, text) for part in batches_by_id(docs, id_col, batches)])
    found = found.select(F.col("doc").alias("_doc"), F.col("w").alias("_w"), "gone")
    rows = docs.select(F.col(id_col).alias("id"), text_column(docs, text).alias("text")).withColumn("w", F.xxhash64("text"))
    both = rows.join(found, F.col("id").eqNullSafe(F.col("_doc")) & (F.col("w") == F.col("_w")), "left")
    split = both.select("id", "text", lines(F.col("text")).alias("lines"), "gone")
    return split.select(
        F.col("id").alias(id_col), without(F.col("text"), F.col("lines"), F.col("gone")).alias("kept"),
        F.size("lines").cast("bigint").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
