"""Checkpoints of finished pages: JSON lines ``{"page": n, "items": [{…}]}`` per contract."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.operators.dedup import latest_wins
from pagelake.sources.versions import Versions, names_in, remove

ITEMS = "array<map<string,string>>"


def parse_lines(lines: DataFrame, text: str = "value", order: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(keep…, page_no, items)`` of the valid lines, the last line of a page winning.

    A line counts if it is JSON with a page of 1 or more and a list of objects as items.
    """
    order = order or ["line_no"]
    v = F.try_parse_json(text)
    page = F.coalesce(
        F.try_variant_get(v, "$.page", "bigint"),
        F.try_variant_get(v, "$.page", "string").try_cast("bigint"),
    )
    entries = F.try_variant_get(v, "$.items", "array<variant>")
    all_objects = F.forall(entries, lambda x: F.try_variant_get(x, "$", "map<string,variant>").isNotNull())
    rows = lines.select(*keep, *order, page.alias("page_no"), entries.alias("_e"), all_objects.alias("_ok")).filter(
        (F.col("page_no") >= 1) & F.col("_e").isNotNull() & F.col("_ok")
    )
    items = F.transform("_e", lambda x: F.try_variant_get(x, "$", "map<string,string>"))
    typed = rows.select(*keep, *order, "page_no", items.alias("items"))
    return latest_wins(typed, [*keep, "page_no"], order).select(*keep, "page_no", "items")


def load(spark: SparkSession, path: str, sig: str) -> DataFrame:
    """The checkpoint of one contract; an absent one is empty. Other contracts are not read.

    The order of the saves decides, as their folders are numbered; files put there by hand
    count as older than any save.
    """
    folder = f"{path}/sig={sig}"
    saves = Versions(spark, folder).latest()[1].get("saves", [])
    loose = [name for name, is_dir in names_in(spark, folder) if not is_dir and name[0] not in "_."]
    places = [f"{folder}/{name}" for name in (*saves, *loose)]
    if not places:
        return spark.createDataFrame([], f"page_no bigint, items {ITEMS}")
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/save=(\d+)-[0-9a-f]+/[^/]*$", 1)
    lines = spark.read.text(places).select(
        "value", F.coalesce(number.try_cast("bigint"), F.lit(0)).alias("save"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"),
    )
    return parse_lines(lines, order=["save", "file", "block", "line_no"])


def save(pages: DataFrame, path: str, sig: str, most_saves: int = 200) -> None:
    """Add pages ``(page_no, items)`` to a contract's checkpoint.

    The pages go to a folder of their own, which one commit makes part of the checkpoint: all
    become visible or none. Of several saves of a page the latest counts. When ``most_saves``
    have gathered they are written as one.
    """
    spark = pages.sparkSession
    versions = Versions(spark, f"{path}/sig={sig}")
    line = F.to_json(F.struct(F.col("page_no").alias("page"), "items"))

    def add(number: int, manifest: dict) -> dict:
        saves = manifest.get("saves", [])
        rows = pages
        if len(saves) >= most_saves:
            rows, saves = merge_saves(load(spark, path, sig), pages), []
        name = f"save={number + 1:012d}-{uuid.uuid4().hex[:12]}"
        rows.select(line.alias("value")).write.text(f"{path}/sig={sig}/{name}")
        return {"saves": [*saves, name]}

    versions.change(add)


def merge_saves(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pages after a further save; a page of the new one replaces the old."""
    sides = old.withColumn("_side", F.lit(0)).unionByName(new.select("page_no", "items").withColumn("_side", F.lit(1)))
    return latest_wins(sides, ["page_no"], ["_side"]).drop("_side")


def compact(spark: SparkSession, path: str, sig: str, into: str) -> None:
    """Write the loaded state of a contract to another root, one line per page."""
    save(load(spark, path, sig), into, sig)


def clear(spark: SparkSession, path: str, sig: str) -> bool:
    """Drop a contract's pages after success; False if there were none."""
    return remove(spark, f"{path}/sig={sig}")
