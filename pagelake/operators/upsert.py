"""Upserts, idempotent appends and schema evolution between two tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.functions.hashing import row_fingerprint
from pagelake.functions.text import sanitize_identifier
from pagelake.functions.urls import url_fingerprint

# Columns of a cleaned table that items cannot set.
RESERVED = ("id", "url", "url_hash", "site_name", "cleaned_at")
KEY = ["site_name", "url_hash"]


def _stamp(run_ts: Column | str) -> Column:
    return F.lit(run_ts) if isinstance(run_ts, str) else run_ts


def reduce_raw(batch: DataFrame, version: str) -> DataFrame:
    """A batch ``(site_name, url, raw_data, version)`` as one row per key, with its version ``_seq``.

    The payload is that of the highest version, the URL that of the lowest. One aggregation with
    partial results before the shuffle, so a URL that comes a million times leaves each task once.
    """
    rows = batch.select("site_name", "url", url_fingerprint("url").alias("url_hash"), "raw_data", F.col(f"`{version}`").cast("bigint").alias("_seq"))
    order = F.struct("_seq")  # a struct, so that rows without a version count too, as the oldest
    return rows.groupBy(*KEY).agg(
        F.min_by("url", order).alias("url"), F.max_by("raw_data", order).alias("raw_data"), F.max("_seq").alias("_seq")
    )


def merge_raw(existing: DataFrame, reduced: DataFrame, run_ts: Column | str) -> DataFrame:
    """Raw records and the reduced batch in one join on the key.

    Where ``existing`` keeps versions (``_seq``), a batch row that is older than the stored one
    changes nothing; else the batch replaces.
    """
    stamp = _stamp(run_ts).cast(existing.schema["updated_at"].dataType)
    known = F.col("o._there").isNotNull()
    versions = "_seq" in existing.columns
    taken = F.col("n._there").isNotNull()
    if versions:
        newer = F.struct("n._seq") >= F.struct("o._seq")
        taken = taken & (~known | newer)
    both = _on_key(existing, reduced)
    pick = lambda c: F.when(taken, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(
        F.col("o.id").alias("id"), *_key(), F.when(known, F.col("o.url")).otherwise(F.col("n.url")).alias("url"),
        pick("raw_data").alias("raw_data"), F.when(taken, "crawled").otherwise(F.col("o.status")).alias("status"),
        F.when(known, F.col("o.created_at")).otherwise(stamp).alias("created_at"),
        F.when(taken, stamp).otherwise(F.col("o.updated_at")).alias("updated_at"), *([pick("_seq").alias("_seq")] if versions else []),
    ).select("id", "site_name", "url", "url_hash", "raw_data", "status", "created_at", "updated_at", *(["_seq"] if versions else []))


def _on_key(existing: DataFrame, reduced: DataFrame) -> DataFrame:
    old, new = existing.withColumn("_there", F.lit(True)).alias("o"), reduced.withColumn("_there", F.lit(True)).alias("n")
    same = F.lit(True)
    for k in KEY:
        same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    return old.join(new, same, "full_outer")


def _key() -> list[Column]:
    there = F.col("o._there").isNotNull()
    return [F.when(there, F.col(f"o.{k}")).otherwise(F.col(f"n.{k}")).alias(k) for k in KEY]


def raw_upsert(existing: DataFrame, batch: DataFrame, version: str, run_ts: Column | str) -> DataFrame:
    """Raw records after a batch, one per (site_name, url_hash).

    ``existing(id, site_name, url, url_hash, raw_data, status, created_at, updated_at)``,
    unique by key, ``batch(site_name, url, raw_data, version)``. On a conflict raw_data, status
    and updated_at are new, id, url and created_at stay. New rows have no id yet. The batch is
    reduced to one row per key before it meets the table.
    """
    return merge_raw(existing, reduce_raw(batch, version), run_ts)


def store_type(dtype: T.DataType) -> str:
    """Column type of a cleaned table for a value type."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.IntegralType):
        return "bigint"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "double"
    return "string"


def store_names(spark: SparkSession, names: Iterable[str]) -> dict[str, str]:
    """Legal column names of a cleaned table, by the same rule as the column function.

    The names are literals, so this is one row of folded constants.
    """
    names = list(names)
    legal = [F.coalesce(F.nullif(sanitize_identifier(F.lit(n)), F.lit("")), F.lit("col")) for n in names]
    row = spark.sql("select 1").select(*[c.alias(f"c{i}") for i, c in enumerate(legal)]).first()
    return dict(zip(names, row))


def stored_items(items: DataFrame, skip: Iterable[str] = ()) -> dict[str, Column]:
    """Item columns under legal names and stored types; nested values become JSON text.

    Reserved columns are left out, and of two columns with one legal name the first counts.
    """
    nested = (T.ArrayType, T.MapType, T.StructType)
    fields = [f for f in items.schema.fields if f.name not in set(skip)]
    names = store_names(items.sparkSession, [f.name for f in fields]) if fields else {}
    out: dict[str, Column] = {}
    for f in fields:
        c = F.col(f"`{f.name}`")
        if names[f.name] not in RESERVED:
            out.setdefault(names[f.name], F.to_json(c) if isinstance(f.dataType, nested) else c.cast(store_type(f.dataType)))
    return out


def widened(a: T.DataType, b: T.DataType) -> T.DataType:
    """The stored type that holds values of both: two kinds of numbers give a double, anything else text."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    numbers = (T.IntegralType, T.FractionalType)
    return T.DoubleType() if isinstance(a, numbers) and isinstance(b, numbers) else T.StringType()


def reduce_cleaned(batch: DataFrame, version: str) -> DataFrame:
    """A batch with any columns as one row per key under stored names and types, with its version ``_seq``."""
    picked = stored_items(batch, skip=("site_name", "url", version))
    url = F.coalesce("url", F.lit(""))
    rows = batch.select(
        "site_name", url.alias("url"), F.when(url != "", url_fingerprint("url")).otherwise("").alias("url_hash"),
        *[c.alias(n) for n, c in picked.items()], F.col(f"`{version}`").cast("bigint").alias("_seq"),
    )
    last = F.max_by(F.struct("url", *picked), F.struct("_seq")).alias("_last")
    reduced = rows.groupBy(*KEY).agg(last, F.max("_seq").alias("_seq"))
    return reduced.select(*KEY, "_last.url", *[F.col("_last")[c].alias(c) for c in picked], "_seq")


def merge_cleaned(existing: DataFrame, reduced: DataFrame, run_ts: Column | str) -> DataFrame:
    """Cleaned records and the reduced batch in one join on the key.

    A column whose types differ is widened, so that one source that drifts does not stop the
    table. Versions count as in ``merge_raw``.
    """
    stamp = _stamp(run_ts).cast(existing.schema["cleaned_at"].dataType)
    known, taken = F.col("o._there").isNotNull(), F.col("n._there").isNotNull()
    versions = "_seq" in existing.columns
    if versions:
        taken = taken & (~known | (F.struct("n._seq") >= F.struct("o._seq")))
    items = [c for c in reduced.columns if c not in (*KEY, "url", "_seq")]
    kept = [c for c in existing.columns if c not in (*KEY, "url", "cleaned_at", "_seq", *items)]

    def pick(c: str) -> Column:
        if c not in existing.columns:
            return F.when(taken, F.col(f"n.`{c}`")).alias(c)
        kind = widened(existing.schema[c].dataType, reduced.schema[c].dataType)
        return F.when(taken, F.col(f"n.`{c}`").cast(kind)).otherwise(F.col(f"o.`{c}`").cast(kind)).alias(c)

    return _on_key(existing, reduced).select(
        *_key(), pick("url"), F.when(known, F.col("o.cleaned_at")).otherwise(stamp).alias("cleaned_at"),
        *[F.col(f"o.`{c}`").alias(c) for c in kept], *[pick(c) for c in items], *([pick("_seq")] if versions else []),
    ).select("site_name", "url", "url_hash", "cleaned_at", *[f"`{c}`" for c in (*kept, *items)], *(["_seq"] if versions else []))


def cleaned_upsert(existing: DataFrame, batch: DataFrame, version: str, run_ts: Column | str) -> DataFrame:
    """Cleaned records after a batch with any columns, one per (site_name, url_hash).

    ``batch`` has ``site_name``, ``url``, the version column and item columns. Columns of
    the batch replace, columns only the table has stay, new columns are added, and a column
    that changes its type is widened.
    """
    return merge_cleaned(existing, reduce_cleaned(batch, version), run_ts)


def evolve(*tables: DataFrame) -> DataFrame:
    """Rows of all tables under the union of their columns; what a table lacks is null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def idempotent_append(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch rows to insert: not yet in the table by full-row text, each once.

    Both sides are compared over the union of their columns, a missing value counts as ''.
    The table is shuffled as distinct 32-byte digests, not as rows.
    """
    columns = list(dict.fromkeys([*existing.columns, *batch.columns]))

    def digest(df: DataFrame) -> Column:
        present = df.select("*", *[F.lit("").alias(c) for c in columns if c not in df.columns])
        return present.withColumn("_fp", F.unhex(row_fingerprint(columns)))

    rows = digest(batch).select(
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in batch.columns], "_fp"
    )
    known = digest(existing).select("_fp").distinct()
    return rows.dropDuplicates(["_fp"]).join(known, "_fp", "left_anti").drop("_fp")


def set_status(raw: DataFrame, updates: DataFrame, version: str, run_ts: Column | str) -> DataFrame:
    """Set the status by url_hash, on every site that has it; the latest update counts."""
    run_ts = F.lit(run_ts) if isinstance(run_ts, str) else run_ts
    last = updates.groupBy("url_hash").agg(F.max_by("status", version).alias("_status"))
    hit = F.col("_status").isNotNull()
    return (
        raw.join(last, "url_hash", "left")
        .withColumns(
            {
                "status": F.coalesce("_status", "status"),
                "updated_at": F.when(hit, run_ts.cast(raw.schema["updated_at"].dataType)).otherwise(F.col("updated_at")),
            }
        )
        .drop("_status")
    )


def key_audit(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Keys that are not unique, with their counts: to be empty before a key is declared."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def merge_checkpoint(existing: DataFrame, batch: DataFrame, version: str, keys: tuple[str, ...] = ("sig", "page_no")) -> DataFrame:
    """Checkpoint pages after a batch; the last write of a page wins."""
    from pagelake.operators.dedup import latest_wins

    sides = existing.withColumn("_side", F.lit(0)).unionByName(batch.withColumn("_side", F.lit(1)))
    return latest_wins(sides, list(keys), ["_side", version]).drop("_side")


__all__ = [
    "cleaned_upsert", "evolve", "idempotent_append", "key_audit", "merge_checkpoint", "merge_cleaned", "merge_raw",
    "raw_upsert", "reduce_cleaned", "reduce_raw", "sanitize_identifier", "set_status", "store_names", "store_type", "stored_items", "widened",
]
