"""Running sums, ranks and exact quantiles without a one-task global sort.

A window over a whole class, fold or combination would sort that group in a single
task. Here a monotone function cuts the order column into fine cells (2^24 per power
of two, so a single-precision value shares its cell with no other value), and every
4,096 neighbouring fine cells form a coarse cell. Running sums are then taken in three
bounded steps: over the coarse cells of a group, over the fine cells of a coarse cell,
over the rows of a fine cell. The cell function depends on the value alone, so a
recomputed task lands in the same cells. Strings are dealt by sampled ranges instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.session import durable

FINE_BITS = 24  # fine cells per power of two, as a power of two
COARSE_SHIFT = 12  # fine cells per coarse cell, likewise


def _number_cell(x: Column) -> Column:
    """Log-linear cell of a number: exponent plus the leading mantissa bits.

    `floor(log2)` may be off by one next to a power of two; both readings give the same
    cell there, so the map stays monotone.
    """
    x = x.cast("double")
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    size = F.when(odd, F.lit(1.0)).otherwise(F.abs(x))
    exponent = F.floor(F.log2(size))
    mantissa = F.floor((size / F.pow(F.lit(2.0), exponent) - 1.0) * float(1 << FINE_BITS))
    cell = ((exponent + 1100) * (1 << FINE_BITS) + mantissa).cast("bigint")
    # infinities lie beyond all finite cells, and NaN is above them, as in Spark's own order
    end = F.lit(2300 << FINE_BITS).cast("bigint")
    signed = F.when(F.isnan(x), end + 1).when(odd, F.when(x > 0, end).otherwise(-end))
    signed = signed.when(size == 0, F.lit(0)).otherwise(F.signum(F.when(odd, F.lit(1.0)).otherwise(x)).cast("bigint") * cell)
    # never null, so no null filter is inferred and the branches can share one exchange
    return F.coalesce(signed, F.lit(0).cast("bigint"))


def _with_cells(df: DataFrame, keys: list[str], order: str, ties: Sequence[str], ascending: bool) -> DataFrame:
    """Add `_fine` and `_coarse`.

    Strings have no arithmetic: rows are dealt by range over (group, string, ties), with
    splitters that Spark samples, and the range is the cell. Paths that share long prefixes
    spread like any others. The dealing is written down, so that all later steps see the same.
    """
    if dict(df.dtypes)[order] != "string":
        fine = df.withColumn("_fine", _number_cell(F.col(order)))
        return fine.withColumn("_coarse", F.shiftright("_fine", COARSE_SHIFT))
    by = [*keys, order, *(ties if ascending else ())]
    dealt = durable(df.repartitionByRange(*[F.col(c) for c in by]).withColumn("_fine", F.spark_partition_id().cast("bigint")))
    return dealt.withColumn("_coarse", F.shiftright("_fine", COARSE_SHIFT))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Sequence[str],
    ascending: bool = True,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Add `before_<c>`, the sum of `c` over the earlier rows of the group, and `total_<c>`.

    Keys must not be NULL. `order` should be unique inside a group (aggregate to distinct values first) or be
    made unique by `ties`. Cell tables are joined without a hint: Spark broadcasts them
    only below its own size limit. Infinities come first and last, NaN after all numbers.
    """
    keys = list(keys)
    if not keys:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    direction = (lambda c: F.col(c).asc()) if ascending else (lambda c: F.col(c).desc())

    def earlier(by: list[str], *order_by: Column):
        """Sum over the earlier rows of a window, 0 for the first; one window for all sums."""
        w = W.partitionBy(*by).orderBy(*order_by).rowsBetween(W.unboundedPreceding, -1)
        zero = F.lit(0)
        return lambda c: F.coalesce(F.sum(c).over(w), zero)

    celled = _with_cells(df, keys, order, ties, ascending)
    fine = celled.groupBy(*keys, "_coarse", "_fine").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    coarse = fine.groupBy(*keys, "_coarse").agg(*[F.sum(f"_t_{c}").alias(f"_t_{c}") for c in sums])
    whole, ahead = W.partitionBy(*keys), earlier(keys, direction("_coarse"))
    coarse = coarse.select(
        *keys,
        "_coarse",
        *[ahead(f"_t_{c}").alias(f"_o1_{c}") for c in sums],
        *[F.sum(f"_t_{c}").over(whole).alias(f"total_{c}") for c in sums],
    )
    ahead = earlier([*keys, "_coarse"], direction("_fine"))
    fine = fine.join(coarse, [*keys, "_coarse"]).select(
        *keys,
        "_fine",
        *[(F.col(f"_o1_{c}") + ahead(f"_t_{c}")).alias(f"_o_{c}") for c in sums],
        *[f"total_{c}" for c in sums],
    )
    ahead = earlier([*keys, "_fine"], direction(order), *[F.col(t).asc() for t in ties])
    local = celled.drop("_coarse").select("*", *[ahead(c).alias(f"_l_{c}") for c in sums])
    return local.join(fine, [*keys, "_fine"]).select(
        *[c for c in df.columns if c != "_all"],
        *[(F.col(f"_l_{c}") + F.col(f"_o_{c}")).alias(f"before_{c}") for c in sums],
        *[f"total_{c}" for c in sums],
    )


def position(
    df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str] = (), name: str = "pos", **kw
) -> DataFrame:
    """0-based position of every row inside its group (a distributed row_number)."""
    counted = running(df.withColumn("_one", F.lit(1).cast("bigint")), keys, order, ["_one"], ties=ties, **kw)
    return counted.select(*df.columns, F.col("before__one").alias(name))


def hash_rank(
    df: DataFrame,
    keys: Sequence[str],
    digest: str,
    ties: Sequence[str] = (),
    name: str = "pos",
    prefix: int = 4,
) -> DataFrame:
    """0-based position by a hexadecimal digest column.

    A digest is uniform, so its first `prefix` digits cut every group evenly into
    16^prefix cells; cell counts give the offsets.
    """
    keys = list(keys)
    cell = df.withColumn("_cell", F.substring(digest, 1, prefix))
    counts = cell.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inner = W.partitionBy(*keys, "_cell").orderBy(digest, *ties)
    joined = cell.join(offsets, keys + ["_cell"])
    ranked = joined.withColumn(name, F.row_number().over(inner) - 1 + F.col("_o"))
    return ranked.select(*df.columns, name)


def distinct_values(df: DataFrame, keys: Sequence[str], value: str, **sums: Column) -> DataFrame:
    """Collapse equal values per group: `n` rows each, plus any extra sums."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    qs: Sequence[float],
    method: str = "linear",
) -> DataFrame:
    """(keys, q, value) exact quantiles from running counts over distinct values.

    `linear` interpolates between the two neighbouring order statistics; `lower` takes
    the smaller one (the lower median for q = 0.5).
    """
    keys = list(keys)
    counted = running(distinct_values(df, keys, value), keys, value, ["n"])
    rows = counted.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    at = F.col("q") * (F.col("total_n") - 1)
    lo, hi = F.floor(at), F.ceil(at)
    covers = lambda i: (F.col("before_n") <= i) & (i < F.col("before_n") + F.col("n"))
    picked = rows.where(covers(lo) | covers(hi)).groupBy(*keys, "q").agg(
        F.max(F.when(covers(lo), F.col(value))).alias("_a"),
        F.max(F.when(covers(hi), F.col(value))).alias("_b"),
        F.max(at - lo).alias("_f"),
    )
    if method == "lower":
        return picked.select(*keys, "q", F.col("_a").alias(value))
    # at an order statistic, or between equal ones, infinities stay what they are
    exact = (F.col("_f") == 0) | (F.col("_a") == F.col("_b"))
    between = F.when(exact, F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f"))
    return picked.select(*keys, "q", between.alias(value))


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "avg_rank") -> DataFrame:
    """(keys, value, n, avg_rank): ties share the mean of the ranks they span."""
    counted = running(distinct_values(df, keys, value), keys, value, ["n"])
    return counted.select(*keys, value, "n", (F.col("before_n") + (F.col("n") + F.lit(1)) / F.lit(2.0)).alias(name))


def tie_broken_position(
    df: DataFrame, keys: Sequence[str], value: str, row_id: str, name: str = "pos"
) -> DataFrame:
    """0-based position by (value, row_id), safe when one value is shared by most rows.

    Equal values are cut further by `row_id`, so a value that a third of all rows share
    (an exact zero, say) is spread over many windows.
    """
    keys = list(keys)
    group = [*keys, value]
    celled = df.withColumn("_idc", F.shiftright(_number_cell(F.col(row_id)), COARSE_SHIFT))
    per_cell = celled.groupBy(*group, "_idc").agg(F.count("*").alias("n"))
    inside = W.partitionBy(*group).orderBy("_idc").rowsBetween(W.unboundedPreceding, -1)
    per_cell = per_cell.select(*group, "_idc", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("_in"))
    starts = running(distinct_values(df, keys, value), keys, value, ["n"])
    offsets = per_cell.join(starts.select(*group, "before_n"), group).select(
        *group, "_idc", (F.col("_in") + F.col("before_n")).alias("_o")
    )
    inner = W.partitionBy(*group, "_idc").orderBy(row_id)
    ranked = celled.join(offsets, [*group, "_idc"])
    return ranked.select(*df.columns, (F.row_number().over(inner) - 1 + F.col("_o")).alias(name))


def equal_count_bins(
    df: DataFrame, keys: Sequence[str], value: str, row_id: str, bins: int = 10, name: str = "bin"
) -> DataFrame:
    """Bin number 0..bins-1; the first (n mod bins) bins hold one row more."""
    keys = list(keys)
    ranked = tie_broken_position(df, keys, value, row_id, "_pos")
    size = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    ranked = ranked.join(size, keys) if keys else ranked.crossJoin(F.broadcast(size))  # no keys: one row
    base, extra = F.floor(F.col("_n") / bins), F.col("_n") % bins
    big = extra * (base + 1)
    small = extra + F.floor((F.col("_pos") - big) / F.greatest(base, F.lit(1)))
    number = F.when(F.col("_pos") < big, F.floor(F.col("_pos") / (base + 1))).otherwise(small)
    return ranked.select(*df.columns, number.cast("int").alias(name))
