"""Positions of rows in a sorted order, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.sizes import SENT_BYTES
from tessella.session import durable

#: monotonically_increasing_id counts rows of a partition below this bit and partitions above it.
ROW_BITS = 33


def small(df: DataFrame, row_bytes: int = 128) -> DataFrame:
    """`df`, which should be written down already, marked for broadcast where its counted rows fit the limit."""
    return F.broadcast(df) if row_bytes * df.count() <= SENT_BYTES else df


def in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` sorted over all partitions by `order` and written down, with `_part` and `_row`, the place in the partition.

    Rows that are equal in `order` may lie in several partitions, so a value that very many rows
    share is no hot task.
    """
    own = durable(rows.withColumn("_own", F.monotonically_increasing_id()))
    keys = [*[F.col(c) for c in order], F.col("_own")]
    placed = durable(own.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_own").withColumn("_at", F.monotonically_increasing_id()))
    return placed.withColumns({"_part": F.shiftright("_at", ROW_BITS), "_row": F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))}).drop("_at")


def positions(rows: DataFrame, group: list[str], order: list[str], size: str | None = None) -> DataFrame:
    """`rows` with `pos`, the place from 0 in its group by `order`, and `n_group`; with `size`, also `ahead` and `all_size`: sums of it before the row and in its group.

    Nulls come first and are equal to each other in `group`. Only a row for each partition and
    group that meet is put together; in a group these are at most as many as partitions.
    """
    at = in_order(rows, [*group, *order])
    part = at.groupBy("_part", *group).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"), *([F.sum(size).alias("_s")] if size else []))
    of_group = Window.partitionBy(*[F.col(c) for c in group]) if group else Window.partitionBy(F.lit(0))
    before = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = {"_before": F.coalesce(F.sum("_n").over(before), zero), "n_group": F.sum("_n").over(of_group)}
    if size:
        sums |= {"_ahead": F.coalesce(F.sum("_s").over(before), zero), "all_size": F.sum("_s").over(of_group)}
    part = part.withColumns(sums).drop("_n", "_s")
    part = durable(part.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_part").alias("_p"), *[c for c in part.columns if c not in {*group, "_part"}]))
    same: Column = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    out = at.join(small(part), same).withColumn("pos", F.col("_row") - F.col("_first") + F.col("_before"))
    if size:
        within = Window.partitionBy("_part", *group).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("ahead", F.col("_ahead") + F.coalesce(F.sum(size).over(within), zero))
    return out.select(*rows.columns, "pos", "n_group", *(["ahead", "all_size"] if size else []))


def depth_bounds(rows: DataFrame, column: str, bins: int) -> list[tuple[int, object]]:
    """(range, first value) of up to `bins` ranges of `column` with about as many rows each.

    A value lies in the range bins * (rows with smaller values) div (all rows), so a value that
    many rows share is a range of its own and the next ones are left out. Nulls are smaller than
    all values and give no bound. At most `bins` values come to the driver.
    """
    values = rows.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    run = positions(values, [], ["v"], "n").where("v is not null")
    first = run.groupBy(F.expr(f"(ahead * {bins}) div all_size").alias("bin")).agg(F.min("v").alias("v"))
    return [(r.bin, r.v) for r in first.orderBy("bin").collect()]


def bin_of(value: Column, bounds: list[tuple[int, object]]) -> Column:
    """The range of a value under `depth_bounds`; 0 for null."""
    out, last = F.lit(0), 0
    for bin, first in bounds:
        out, last = out + F.when(value >= F.lit(first), bin - last).otherwise(0), bin
    return out
