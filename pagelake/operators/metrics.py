"""Metric roll-ups over a table of samples; one pass and map-side sums each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of the latency histogram, seconds.
LATENCY_BUCKETS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0)


def count_by(df: DataFrame, *keys: str | Column, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def requests_rollup(df: DataFrame, site: str = "site") -> DataFrame:
    """Requests per site and over all sites (site null, ``is_total`` 1)."""
    return df.rollup(site).agg(F.count("*").alias("n"), F.grouping(site).cast("int").alias("is_total"))


def latency_histogram(df: DataFrame, site: str = "site", latency: str = "latency") -> DataFrame:
    """Cumulative buckets in long form ``(site, le, n, total, sum_latency)``."""
    bounds = [*[str(b) for b in LATENCY_BUCKETS], "+Inf"]
    counts = [F.count_if(F.col(latency) <= b) for b in LATENCY_BUCKETS] + [F.count(latency)]
    wide = df.groupBy(site).agg(
        F.count(latency).alias("total"),
        F.sum(latency).alias("sum_latency"),
        *[c.alias(f"_b{i}") for i, c in enumerate(counts)],
    )
    pairs = F.array(*[F.struct(F.lit(le).alias("le"), F.col(f"_b{i}").alias("n")) for i, le in enumerate(bounds)])
    return wide.select(site, "total", "sum_latency", F.inline(pairs))


def counters(df: DataFrame, kinds: dict[str, Column], *keys: str) -> DataFrame:
    """Several counters in one pass: name to condition."""
    return df.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in kinds.items()])


def gauges(df: DataFrame, value: str, at: list[str], *keys: str) -> DataFrame:
    """Last value per key."""
    return df.groupBy(*keys).agg(F.max_by(F.col(value), F.struct(*at)).alias("value"))


def success_rate(df: DataFrame, ok: Column, site: str = "site") -> DataFrame:
    return df.groupBy(site).agg(F.avg(F.when(ok, 1.0).otherwise(0.0)).alias("rate"), F.count("*").alias("n"))


def run_summary(items: DataFrame, fields: list[str], started: float, ended: float) -> DataFrame:
    return items.agg(F.count("*").alias("n_items")).withColumns(
        {"n_fields": F.lit(len(fields)), "elapsed": F.lit(float(ended - started))}
    )


def dataset_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table_name, n_rows, n_columns)`` of several tables as one job."""
    parts = [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"),
            F.lit(",".join(df.columns)).alias("columns"),
        )
        for name, df in tables.items()
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union
