"""Isotonic regression over a whole table: adjacent violators are pooled in ranges, then in runs of ranges.

The fit of a range is a list of blocks, each with the mean of its points; fitting the blocks of
neighbouring ranges gives the blocks of both, so ranges are merged in a tree in which only blocks
travel. With 0/1 labels n points leave O(n^(2/3)) blocks, the corners of a convex line on a grid,
so the last merge of a class is small whatever the number of points.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.operators.ordering import position, running
from tessella.session import durable

SPAN = 65_536  # distinct values pooled in a task at first
FAN = 16  # ranges merged in a task afterwards


def pool(lo: np.ndarray, hi: np.ndarray, n: np.ndarray, y: np.ndarray) -> list[tuple]:
    """(lo, hi, n, y) of the blocks of ascending ones: a block joins the one before while its mean is not larger."""
    out: list[tuple] = []
    for a, b, w, s in zip(lo.tolist(), hi.tolist(), n.tolist(), y.tolist()):
        while out and out[-1][3] * w >= s * out[-1][2]:
            a, _, w0, s0 = out.pop()
            w, s = w + w0, s + s0
        out.append((a, b, w, s))
    return out


def isotonic_blocks(points: DataFrame, keys: Sequence[str], span: int = SPAN, fan: int = FAN) -> DataFrame:
    """(keys, lo, hi, n, y): the blocks of the ascending fit of rows (keys, x, y); the fitted value is y / n.

    Rows with a null or not finite `x`, or a null `y`, take no part. Keys must not be null. Equal
    values of `x` are one point from the start, however many rows have them.
    """
    keys, x = list(keys), F.col("x").cast("double")
    finite = F.col("x").isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) & F.col("y").isNotNull()
    distinct = points.where(finite).groupBy(*keys, x.alias("x")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("y").cast("double")).alias("y"))
    ranked = position(distinct, keys, "x", name="_pos")
    parts = durable(ranked.select(*keys, F.floor(F.col("_pos") / span).cast("bigint").alias("_run"), F.col("x").alias("lo"), F.col("x").alias("hi"), "n", "y"))
    schema, last = parts.schema, parts.agg(F.max("_run")).first()[0] or 0
    arrow = to_arrow_schema(schema)
    width = len(keys) + 1

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by("lo")
        made = pool(*(rows.column(c).to_numpy() for c in ("lo", "hi", "n", "y")))
        head = [pa.array([key[i].as_py()] * len(made), arrow.field(i).type) for i in range(width)]
        return pa.Table.from_arrays([*head, *(pa.array(c, pa.float64()) for c in zip(*made))], schema=arrow)

    blocks = parts.groupBy(*keys, "_run").applyInArrow(merge, schema)
    while last > 0:
        up = blocks.withColumn("_run", F.floor(F.col("_run") / fan).cast("bigint"))
        blocks, last = up.groupBy(*keys, "_run").applyInArrow(merge, schema), last // fan
    return blocks.drop("_run")


def isotonic_values(values: DataFrame, blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, x, value) of each distinct `x` of `values`: a block's mean inside it, the straight line between blocks, the end blocks' beyond.

    NULL for a group without blocks and for NaN. The block of a value is the number of blocks that
    begin at or before it, a distributed running sum.
    """
    keys = list(keys)
    blocks = position(durable(blocks.select(*keys, "lo", "hi", (F.col("y") / F.col("n")).alias("value"))), keys, "lo", name="_i")
    begin = blocks.select(*keys, F.col("lo").alias("x"), F.lit(1).alias("_b"))
    asked = values.where(F.col("x").isNotNull()).select(*keys, F.col("x").cast("double").alias("x"), F.lit(0).alias("_b"))
    marks = running(begin.unionAll(asked).groupBy(*keys, "x").agg(F.sum("_b").alias("_b")), keys, "x", ["_b"])
    at = marks.select(*keys, "x", (F.col("before__b") + F.col("_b") - 1).alias("_at")).withColumn("_i", F.greatest("_at", F.lit(0)))
    after = blocks.select(*keys, (F.col("_i") - 1).alias("_i"), F.col("lo").alias("_lo"), F.col("value").alias("_v"))
    near = at.join(blocks.drop("lo"), [*keys, "_i"], "left").join(after, [*keys, "_i"], "left")
    inside = (F.col("_at") < 0) | (F.col("x") <= F.col("hi")) | F.col("_lo").isNull()
    line = F.col("value") + (F.col("_v") - F.col("value")) * (F.col("x") - F.col("hi")) / (F.col("_lo") - F.col("hi"))
    return near.select(*keys, "x", F.when(F.isnan("x"), None).when(inside, F.col("value")).otherwise(line).alias("value"))


def isotonic(calibration: DataFrame, scores: DataFrame, classes: Sequence[str], span: int = SPAN, fan: int = FAN) -> DataFrame:
    """`scores` recalibrated per class by isotonic regression on `calibration`, clipped to [0, 1].

    A class without calibration rows keeps its scores, clipped; null and NaN scores stay what they
    are, and so do null and empty arrays. Nothing is pooled or looked up on the driver.
    """
    label = calibration.select(F.posexplode(F.arrays_zip("scores", "label")).alias("k", "p"))
    blocks = isotonic_blocks(label.select("k", F.col("p.scores").alias("x"), F.col("p.label").alias("y")), ["k"], span, fan)
    rows = durable(scores.withColumn("_row", F.monotonically_increasing_id()))
    each = rows.select("_row", F.posexplode("scores").alias("k", "x")).where(F.col("k") < len(classes)).withColumn("x", F.col("x").cast("double"))
    fitted = isotonic_values(each, blocks, ["k"])
    value = F.when(F.isnan("x"), F.col("x")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("value", "x"))))
    value = F.when(F.col("x").isNotNull(), value)
    lists = each.join(fitted, ["k", "x"], "left").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("k", value.alias("c")))).alias("_new"))
    out = rows.join(lists, "_row", "left")
    return out.withColumn("scores", F.coalesce(F.transform("_new", lambda s: s["c"]), "scores")).select(*scores.columns)
