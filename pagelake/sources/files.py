"""Text, JSON lines and CSV files, in and out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.functions.text import collapse, strip

PREVIEW_ROWS = 200


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Items from JSON lines; blank lines give nothing. Give a schema to save the inference pass."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def union_records(*tables: DataFrame) -> DataFrame:
    """Records with differing keys under the union of the keys."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def read_csv_preview(spark: SparkSession, path: str, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows of a CSV with a header; a byte-order mark is not part of a name."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns]).limit(rows)


def text_entries(lines: DataFrame, text: str, order: list[str]) -> DataFrame:
    """One entry per line, trimmed, without blanks and # comments, each once at its first place."""
    entries = lines.select(strip(text).alias("entry"), *order).filter(
        (F.col("entry") != "") & ~F.col("entry").startswith("#")
    )
    first = W.partitionBy("entry").orderBy(*order)
    return entries.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def read_text_list(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a list file (or folder of files) with their place ``(file, line_no)``.

    Each file is read whole, one row per file, so that line numbers exist; meant for
    hand-kept lists.
    """
    whole = spark.read.option("wholetext", True).text(path).select(
        F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r\n|\n|\r")).alias("line_no", "line")
    )
    return text_entries(whole, "line", ["file", "line_no"])


def entries_of(value: str | Iterable[str]) -> list[str]:
    """The same for a value given in a configuration: comma text or a list."""
    parts = value.split(",") if isinstance(value, str) else [str(v) for v in value]
    return list(dict.fromkeys(p.strip() for p in parts if p.strip()))


def distinct_seeds(urls: DataFrame, url: str = "url") -> DataFrame:
    return urls.select(url).distinct()


# --- sinks --------------------------------------------------------------------------------


def write_raw_jsonl(items: DataFrame, path: str, site: str | Column, day: str | Column) -> None:
    """Append raw items as JSON lines, a folder per site and day."""
    site = F.lit(site) if isinstance(site, str) else site
    day = F.lit(day) if isinstance(day, str) else day
    (
        items.withColumns({"site": site, "dt": day})
        .write.mode("append").partitionBy("site", "dt").json(path)
    )


def write_parquet(items: DataFrame, path: str, partition_by: Iterable[str] = (), mode: str = "overwrite") -> None:
    items.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_csv(items: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, quoted as spreadsheets read it; nested values as JSON. No byte-order mark."""
    flat = items.select(
        *[
            F.to_json(f"`{f.name}`").alias(f.name)
            if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
            else F.col(f"`{f.name}`")
            for f in items.schema.fields
        ]
    )
    exact = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    flat.write.mode(mode).option("header", True).option("escape", '"').options(**exact).csv(path)


def append_logs(lines: DataFrame, path: str, day: str | Column) -> None:
    """Append log rows ``(task_id, created_at, text)``, a folder per day (tasks are too many)."""
    day = F.lit(day) if isinstance(day, str) else day
    lines.withColumn("dt", day).write.mode("append").partitionBy("dt").parquet(path)


def one_line(c: Column | str) -> Column:
    return collapse(c)
