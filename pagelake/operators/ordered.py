"""Order-dependent work that never puts a whole group into one task.

A running value over a long group is computed in blocks: a group of more than a given number
of rows is cut at quantiles of its own order column, so that a block is bounded in rows, however
densely they lie. Each (group, block) is scanned on its own, one summary row per block is combined
over the group, and the result is added back. Only the summaries of a group meet in one task,
and there is one per block, not per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelake.session import cut

#: About how many rows a block has.
ROWS = 200_000


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    rows: int = ROWS,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running sums and maxima up to and including each row, per group.

    ``order[0]`` must be a number; ``rows`` is about the size of a block.
    """
    sums, maxima = sums or {}, maxima or {}
    names = {**sums, **maxima}
    total = {n: F.sum if n in sums else F.max for n in names}
    tagged = blocks(df, keys, order[0], rows)
    in_block = W.partitionBy("_g", "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = tagged.withColumns({n: total[n](c).over(in_block) for n, c in names.items()})

    summaries = tagged.groupBy("_g", "_block").agg(*[total[n](c).alias(f"_{n}") for n, c in names.items()])
    before = W.partitionBy("_g").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = summaries.select("_g", "_block", *[total[n](f"_{n}").over(before).alias(f"_{n}") for n in names])
    result = {
        n: F.coalesce(F.col(n) + F.col(f"_{n}"), F.col(n), F.col(f"_{n}")) if n in sums
        else F.greatest(F.col(n), F.col(f"_{n}"))
        for n in names
    }
    joined = local.join(carried, ["_g", "_block"], "left")
    return joined.withColumns(result).drop("_g", "_block", *[f"_{n}" for n in names])


def blocks(df: DataFrame, keys: list[str], order: str, rows: int = ROWS) -> DataFrame:
    """Tag each row with its group ``_g`` (a struct, so a missing key is a key) and ``_block``.

    Blocks of a group are numbered from 0 in the order of ``order``. The cuts of the groups that
    need any are worked out once and written, so a lost task finds the same ones; rows with
    one value of ``order`` stay together.
    """
    tagged = df.withColumn("_g", F.struct(*keys))
    longest = tagged.groupBy("_g").count().agg(F.max("count")).first()[0] or 0
    if longest <= rows:
        return tagged.withColumn("_block", F.lit(0).cast("bigint"))
    parts = -(-longest // rows)
    quantiles = F.percentile_approx(order, [k / parts for k in range(1, parts)], max(10_000, 10 * parts))
    long = tagged.groupBy("_g").agg(F.count("*").alias("_n"), quantiles.alias("_cuts")).filter(F.col("_n") > rows)
    cuts = cut(long.select("_g", F.array_distinct("_cuts").alias("_cuts")))
    return tagged.join(cuts, "_g", "left").withColumn("_block", _cuts_up_to(F.col("_cuts"), F.col(order), parts)).drop("_cuts")


def _cuts_up_to(cuts: Column, value: Column, most: int) -> Column:
    """How many of the sorted cuts are not above a value, by halving; 0 where there are no cuts."""
    steps = F.array(*[F.lit(1 << k).cast("bigint") for k in range(most.bit_length(), -1, -1)])

    def halve(at: Column, step: Column) -> Column:
        return F.when(F.get(cuts, (at + step - 1).cast("int")) <= value, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0).cast("bigint"), halve)


def paced(
    df: DataFrame, keys: list[str], at: str, tie: str, interval: int, rows: int = ROWS, name: str = "slot"
) -> DataFrame:
    """``slot = max(at, previous slot + interval)`` per group, in the same whole unit as ``at``.

    Closed form: with ``r`` the row number in the group, the slot is
    ``r*interval + max(at_j - r_j*interval)`` over the rows j up to this one.
    """
    step = F.lit(interval).cast("bigint")
    tagged = blocks(df, keys, at, rows)
    in_block = W.partitionBy("_g", "_block").orderBy(at, tie)
    local = tagged.withColumn("_r", F.row_number().over(in_block).cast("bigint"))
    local = local.withColumn(
        "_m", F.max(F.col(at) - F.col("_r") * step).over(in_block.rowsBetween(W.unboundedPreceding, 0))
    )
    summaries = local.groupBy("_g", "_block").agg(
        F.max("_r").alias("_n"), F.max(F.col(at) - F.col("_r") * step).alias("_top")
    )
    before = W.partitionBy("_g").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = summaries.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    carried = offsets.select(
        "_g", "_block", "_off", F.max(F.col("_top") - F.col("_off") * step).over(before).alias("_prior")
    )
    # Every row has its block; as an outer join both branches can share one shuffle.
    joined = local.join(carried, ["_g", "_block"], "left")
    best = F.greatest(F.col("_m") - F.col("_off") * step, F.col("_prior"))
    slot = (F.col("_r") + F.col("_off")) * step + best
    return joined.withColumn(name, slot).drop("_g", "_block", "_r", "_m", "_off", "_prior")


def number_rows(df: DataFrame, order: list, name: str = "row_no", partitions: int | None = None) -> DataFrame:
    """Number all rows from 1 in a total order without one task seeing them all.

    Rows are range-partitioned and sorted, then written to the shared checkpoint
    folder: the ranges come from a sample, and a second evaluation could draw others.
    What is broadcast after that has one row per partition.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order))
    # The id holds the partition in its upper bits and the place in it in the lower 33.
    placed = placed.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + place + 1)
        .drop("_at", "_part", "_start")
    )


def chunk(df: DataFrame, order: list, size: int, name: str = "chunk") -> DataFrame:
    """Groups of ``size`` consecutive rows, numbered from 0."""
    if size < 1:
        raise ValueError("size must be at least 1")
    numbered = number_rows(df, order, "_row_no")
    return numbered.withColumn(name, F.floor((F.col("_row_no") - 1) / size).cast("bigint")).drop("_row_no")


def page_of(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """LIMIT/OFFSET in an order: each task keeps ``limit + offset`` rows at most."""
    return df.orderBy(*order).offset(offset).limit(limit) if offset else df.orderBy(*order).limit(limit)
