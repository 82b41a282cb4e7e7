"""A keyed table on Parquet: append, upsert, query, count, status, audit.

Rows are dealt to slots by a hash of the site and a hash of the key. An upsert writes the
slots its batch touches to a fresh folder and commits a manifest that points at them, so a
small batch into a large table costs what it touches, and a reader sees the table of one
version, before and after.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.functions.hashing import open_row_fingerprint
from pagelake.operators import upsert
from pagelake.sources import pages as scans
from pagelake.sources.bucketed import read_bucketed_parts, write_bucketed
from pagelake.sources.versions import Conflict, Versions, names_in, remove

RAW_SCHEMA = (
    "id bigint, site_name string, url string, url_hash string, raw_data string, status string,"
    " created_at timestamp, updated_at timestamp"
)
CLEANED_SCHEMA = "site_name string, url string, url_hash string, cleaned_at timestamp"


class TableStore:
    """Raw or cleaned records under one path.

    ``groups`` parts by site and ``buckets`` by key make the slots; both are fixed by the first
    commit. With ``versioned`` the version of every record is kept, and what comes late does not
    replace what is newer; without it the last batch counts, whatever its versions.
    """

    def __init__(self, spark: SparkSession, path: str, kind: str = "raw", buckets: int = 64, groups: int = 16, versioned: bool = False):
        if kind not in ("raw", "cleaned"):
            raise ValueError("kind must be raw or cleaned")
        self.spark, self.path, self.kind = spark, path, kind
        self.versions = Versions(spark, path)
        fixed = self.versions.latest()[1]
        self.buckets, self.groups = fixed.get("buckets", buckets), fixed.get("groups", groups)
        self.versioned = fixed.get("versioned", versioned)

    @property
    def schema(self) -> T.StructType:
        """Columns of an empty table."""
        return T.StructType.fromDDL((RAW_SCHEMA if self.kind == "raw" else CLEANED_SCHEMA) + (", _seq bigint" if self.versioned else ""))

    @property
    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema).drop("_seq")

    def _group(self, site: Column) -> Column:
        return F.pmod(F.xxhash64(site), F.lit(self.groups)).cast("int")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("url_hash"), F.lit(self.buckets)).cast("int")

    def _slot(self) -> Column:
        return self._group(F.col("site_name")) * self.buckets + self._bucket()

    def _rows(self, manifest: dict, slots: set[int] | None = None) -> DataFrame:
        """The rows of a version, of some slots or all, under its newest schema.

        Files written before a column came or was widened are read as they were written and
        cast, one scan for every schema that still has files.
        """
        schemas = [T.StructType.fromJson(json.loads(text)) for text in manifest.get("schemas", [])]
        now = schemas[-1] if schemas else self.schema
        by_schema: dict[int, list[str]] = {}
        for slot, (folder, schema) in sorted(manifest.get("slots", {}).items()):
            if slots is None or int(slot) in slots:
                by_schema.setdefault(schema, []).append(f"{self.path}/data/{folder}/slot={slot}")
        out = None
        for k, paths in sorted(by_schema.items()):
            part = self.spark.read.schema(schemas[k]).parquet(*paths)
            had = set(schemas[k].names)
            part = part.select(*[(F.col(f"`{f.name}`") if f.name in had else F.lit(None)).cast(f.dataType).alias(f.name) for f in now])
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], now) if out is None else out

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of its latest version, or of a given one that has not expired."""
        manifest = self.versions.latest()[1] if version is None else self.versions.read(version)
        return self._rows(manifest).drop("_seq")

    def version(self) -> int:
        return self.versions.latest()[0]

    def _next(self, number: int, manifest: dict, rows: DataFrame, touched: set[int]) -> dict:
        """Write the new rows of some slots and build the manifest that points at them.

        Rebalancing gathers the rows of a slot into few files, yet splits what is large, so a
        site that holds a third of all rows is written by many tasks.
        """
        folder = f"{number + 1:012d}-{uuid.uuid4().hex[:12]}"
        (
            rows.withColumn("slot", self._slot()).hint("rebalance", "slot").sortWithinPartitions("slot", "site_name", "url_hash")
            .write.partitionBy("slot").parquet(f"{self.path}/data/{folder}")
        )
        schemas = list(manifest.get("schemas", []))
        if not schemas or schemas[-1] != rows.schema.json():
            schemas.append(rows.schema.json())
        slots = manifest.get("slots", {}) | {str(s): [folder, len(schemas) - 1] for s in sorted(touched)}
        fixed = {"buckets": self.buckets, "groups": self.groups, "versioned": self.versioned, "kind": self.kind}
        return {**manifest, **fixed, "schemas": schemas, "slots": slots}

    def _touched(self, rows: DataFrame) -> set[int]:
        """Slots that rows fall into: ``groups * buckets`` numbers at most."""
        return {r["slot"] for r in rows.select(self._slot().alias("slot")).distinct().collect()}

    def load(self, rows: DataFrame) -> int:
        """Put records with all their columns into the table, in place of the slots they fall into."""
        rows = rows if not self.versioned or "_seq" in rows.columns else rows.withColumn("_seq", F.lit(None).cast("bigint"))
        return self.versions.change(lambda n, m: self._next(n, m, rows, self._touched(rows)))

    def save(self, batch: DataFrame, version: str, run_ts: str, source: str | None = None, batch_id: int | None = None) -> int:
        """Upsert a batch by (site_name, fingerprint of url); returns the table's version.

        The batch is reduced to one row per key and staged, so that it is evaluated once. A
        batch of a named ``source`` whose ``batch_id`` is not above the last committed one has
        been applied before and changes nothing.
        """
        seen = source is not None and batch_id is not None
        if seen and batch_id <= self.versions.latest()[1].get("sources", {}).get(source, -1):
            return self.version()
        reduce, merge = (upsert.reduce_raw, upsert.merge_raw) if self.kind == "raw" else (upsert.reduce_cleaned, upsert.merge_cleaned)
        reduced = reduce(batch, version)
        place = f"{self.path}/_staging/{uuid.uuid4().hex}"
        reduced.write.parquet(place)
        staged = self.spark.read.schema(reduced.schema).parquet(place)
        touched = self._touched(staged)

        def apply(number: int, manifest: dict) -> dict | None:
            done = manifest.get("sources", {})
            if seen and batch_id <= done.get(source, -1):
                return None
            if touched:
                merged = merge(self._rows(manifest, touched), staged, F.lit(run_ts).cast("timestamp"))
                manifest = self._next(number, manifest, merged, touched)
            return {**manifest, "sources": {**done, source: batch_id}} if seen else manifest if touched else None

        try:
            return self.versions.change(apply)
        finally:
            remove(self.spark, place)

    def set_status(self, updates: DataFrame, version: str, run_ts: str) -> None:
        """Set statuses by url_hash on every site."""
        buckets = {r["b"] for r in updates.select(self._bucket().alias("b")).distinct().collect()}

        def apply(number: int, manifest: dict) -> dict | None:
            slots = {int(s) for s in manifest.get("slots", {}) if int(s) % self.buckets in buckets}
            if not slots:
                return None
            return self._next(number, manifest, upsert.set_status(self._rows(manifest, slots), updates, version, F.lit(run_ts).cast("timestamp")), slots)

        self.versions.change(apply)

    def vacuum(self, keep: int = 2) -> int:
        """Drop versions but the last ``keep``, and folders that none of those names.

        Also what writers that died have left; to be run while no one writes.
        """
        used = {folder for m in self.versions.expire(keep) for folder, _ in m.get("slots", {}).values()}
        gone = [name for name, _ in names_in(self.spark, f"{self.path}/data") if name not in used]
        for name in gone:
            remove(self.spark, f"{self.path}/data/{name}")
        remove(self.spark, f"{self.path}/_staging")
        return len(gone)

    def _of_site(self, site: str) -> DataFrame:
        """The rows of the slots that a site's rows can be in."""
        group = self.spark.sql("select 1").select(self._group(F.lit(site))).first()[0]
        return self._rows(self.versions.latest()[1], set(range(group * self.buckets, (group + 1) * self.buckets))).drop("_seq")

    def query(self, site: str, limit: int = 100, offset: int = 0, status: str | None = None,
              newest: str | None = None) -> DataFrame:
        newest = newest or ("updated_at" if self.kind == "raw" else "cleaned_at")
        return scans.query_site(self._of_site(site), site, limit, offset, status, newest)

    def count(self, site: str, status: str | None = None) -> int:
        return scans.count_site(self._of_site(site), site, status).first()["n"]

    def audit(self) -> DataFrame:
        """Keys that break uniqueness; empty unless something else wrote here."""
        return upsert.key_audit(self.read(), upsert.KEY)


def appended(spark: SparkSession, path: str, last: bool = False) -> DataFrame:
    """The rows of an append table, or those of its last append, under all columns they have."""
    commits = Versions(spark, path).latest()[1].get("commits", [])
    places = [f"{path}/commit={c}" for c in (commits[-1:] if last else commits)]
    if not places:
        return spark.createDataFrame([], "_fp binary").drop("_fp")
    return spark.read.option("mergeSchema", True).parquet(*places).drop("_fp")


def fresh_rows(spark: SparkSession, batch: DataFrame, path: str) -> tuple[DataFrame, int, dict]:
    """The batch rows an append table does not have, each once, with their fingerprint ``_fp``; the version and manifest seen.

    Fingerprints are stored with the rows, in buckets: the table is read by that column alone and stays
    where it is, only the batch is shuffled.
    """
    number, manifest = Versions(spark, path).latest()
    buckets = manifest.get("buckets") or int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest = {"commits": manifest.get("commits", []), "buckets": buckets}
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in batch.columns]
    rows = batch.withColumn("_fp", F.unhex(open_row_fingerprint(batch.columns))).select(*text, "_fp").dropDuplicates(["_fp"])
    if manifest["commits"]:
        known = read_bucketed_parts(spark, path, "_fp binary", ["_fp"], buckets, "commit")
        rows = rows.join(known.filter(F.col("commit").isin(manifest["commits"])).select("_fp"), "_fp", "left_anti")
    return rows, number, manifest


def append_new(spark: SparkSession, batch: DataFrame, path: str) -> int:
    """Idempotent append to a text table that may gain columns; returns the inserted count.

    The rows become part of the table by one commit; against another writer's it is tried again.
    """
    for _ in range(8):
        rows, number, manifest = fresh_rows(spark, batch, path)
        name = f"{number + 1:012d}-{uuid.uuid4().hex[:12]}"
        write_bucketed(rows, f"{path}/commit={name}", ["_fp"], manifest["buckets"])
        n = spark.read.schema("_fp binary").parquet(f"{path}/commit={name}").count()
        try:
            if n:
                Versions(spark, path).commit(number, {**manifest, "commits": [*manifest["commits"], name]})
            else:
                remove(spark, f"{path}/commit={name}")
            return n
        except Conflict:
            remove(spark, f"{path}/commit={name}")
    raise Conflict(f"{path} is written by too many at once")
