"""Per-class thresholds from calibration scores.

Input is wide: `scores array<double>`, `label array<int>`, plus any columns in `by`
(fold, rule, read-out), which must take few values. Output is (by, k, threshold).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.operators.ordering import exact_quantiles

# The three ways to treat a class without positives, the grids.
FALLBACK_UNMIX = 0.05
FALLBACK_MATCH = 0.5
NEVER_FIRES = "never"
FIXED_GRID = 99
RANGE_GRID = 199


def long_scores(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, k, score, label)."""
    return scores.select(*by, F.posexplode(F.arrays_zip("scores", "label")).alias("k", "_e")).select(
        *by, "k", F.col("_e.scores").alias("score"), F.col("_e.label").alias("label")
    )


def quantile_thresholds(
    scores: DataFrame,
    q: float | Sequence[float] = 0.05,
    fallback: float | str = FALLBACK_UNMIX,
    by: Sequence[str] = (),
) -> DataFrame:
    """q-quantile of each class's positives, linear interpolation.

    A class without positives gets `fallback`: a number, or "never" for its maximum
    score plus one. With several quantiles the output also has `q`.
    """
    qs = [q] if isinstance(q, (int, float)) else list(q)
    keys = [*by, "k"]
    long = long_scores(scores, by)
    found = exact_quantiles(long.where("label = 1"), keys, "score", qs).withColumnRenamed("score", "threshold")
    default = F.col("_max") + 1.0 if fallback == NEVER_FIRES else F.lit(float(fallback))
    every = long.groupBy(*keys).agg(F.max("score").alias("_max"))
    every = every.withColumn("q", F.explode(F.array(*[F.lit(float(x)) for x in qs])))
    out = every.join(found, [*keys, "q"], "left").withColumn("threshold", F.coalesce("threshold", default))
    return out.select(*keys, *(["q"] if not isinstance(q, (int, float)) else []), "threshold")


def unknown_threshold(images: DataFrame, column: str, q: float) -> DataFrame:
    """One row: the q-quantile of a per-image score (0.95 of residuals, 0.05 of max-sims)."""
    return exact_quantiles(images.select(column), [], column, [q]).select(F.col(column).alias("unknown_threshold"))


def _best_threshold(curve: DataFrame, keys: Sequence[str], default: float) -> DataFrame:
    """Highest F1; the first (smallest) threshold wins."""
    best = curve.groupBy(*keys).agg(F.max(F.struct("f1", (-F.col("t")).alias("neg_t"))).alias("b"))
    return best.select(*keys, F.coalesce(-F.col("b.neg_t"), F.lit(default)).alias("threshold"), F.col("b.f1").alias("f1"))


def f1_curve(scores: DataFrame, grid: str = "fixed", by: Sequence[str] = (), n_grid: int | None = None) -> DataFrame:
    """(by, k, g, t, tp, fp, fn, f1) for every grid threshold, strict `>`.

    Each score falls into the bucket that counts the thresholds below it, so one
    aggregation to (class, bucket) followed by suffix sums over at most grid-size rows
    replaces testing every score against every threshold.
    """
    keys = [*by, "k"]
    long = long_scores(scores, by)
    if grid == "fixed":
        steps = n_grid or FIXED_GRID
        at = lambda i: (F.lit(0.01) + i * F.lit(0.01)) if steps == 99 else (i + 1) / F.lit(float(steps + 1))
        points = _fixed_points(steps)
        bucketed = long.withColumn("_lo", F.lit(0.0)).withColumn("_hi", F.lit(1.0))
        guess = F.floor(F.col("score") * (steps + 1))
    elif grid == "minmax":
        steps = (n_grid or RANGE_GRID) - 1
        edges = long.groupBy(*keys).agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
        bucketed = long.join(F.broadcast(edges), keys)
        width = (F.col("_hi") - F.col("_lo")) / float(steps)
        points = None
        guess = F.when(width > 0, F.floor((F.col("score") - F.col("_lo")) / width)).otherwise(F.lit(0))
    else:
        raise ValueError(f"unknown grid {grid!r}")

    def threshold(i: Column) -> Column:
        if points is not None:
            return points[i.cast("int")]
        return F.col("_lo") + i * ((F.col("_hi") - F.col("_lo")) / float(steps))

    # bucket = number of thresholds strictly below the score; rounding moves the guess by one
    g = F.greatest(F.lit(0), F.least(guess, F.lit(steps))).cast("int")
    candidates = F.filter(
        F.sequence(F.greatest(g - 2, F.lit(0)), F.least(g + 1, F.lit(steps - 1))),
        lambda i: threshold(i) < F.col("score"),
    )
    below = F.when(F.size(candidates) > 0, F.array_max(candidates) + 1).otherwise(F.greatest(g - 2, F.lit(0)))
    counts = (
        bucketed.withColumn("_b", below)
        .groupBy(*keys, "_b")
        .agg(
            F.sum("label").alias("_pos"),
            F.sum(1 - F.col("label")).alias("_neg"),
            F.min("_lo").alias("_lo"),
            F.min("_hi").alias("_hi"),
        )
    )
    per_class = counts.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("_b", F.struct("_pos", "_neg")))).alias("_m"),
        F.sum("_pos").alias("_P"),
        F.min("_lo").alias("_lo"),
        F.min("_hi").alias("_hi"),
    )
    rows = per_class.select(*keys, "_m", "_P", "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("g"))
    above = W.partitionBy(*keys).orderBy(F.col("g").desc()).rowsBetween(W.unboundedPreceding, 0)
    cell = F.col("_m")[F.col("g") + 1]
    rows = rows.withColumn("tp", F.sum(F.coalesce(cell["_pos"], F.lit(0))).over(above))
    rows = rows.withColumn("fp", F.sum(F.coalesce(cell["_neg"], F.lit(0))).over(above))
    rows = rows.withColumn("fn", F.col("_P") - F.col("tp")).withColumn("t", threshold(F.col("g")))
    denom = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    f1 = F.when(denom > 0, 2.0 * F.col("tp") / denom).otherwise(F.lit(0.0))
    return rows.select(*keys, "g", "t", "tp", "fp", "fn", f1.alias("f1"))


def _fixed_points(steps: int) -> Column:
    import numpy as np

    values = np.linspace(0.01, 0.99, 99) if steps == 99 else np.arange(1, steps + 1) / (steps + 1)
    return F.array(*[F.lit(float(v)) for v in values])


def argmax_f1_thresholds(
    scores: DataFrame,
    grid: str = "fixed",
    by: Sequence[str] = (),
    skip_empty: bool = False,
    default: float | None = None,
) -> DataFrame:
    """Threshold with the best F1 per class.

    `skip_empty` ignores thresholds that predict nothing although positives exist; a class
    left without any then takes `default` (0.5).
    """
    keys = [*by, "k"]
    curve = f1_curve(scores, grid, by)
    if skip_empty:
        empty = (F.col("tp") + F.col("fp") == 0) & (F.col("tp") + F.col("fn") > 0)
        best = _best_threshold(curve.where(~empty), keys, 0.5)
        every = curve.select(*keys).distinct()
        return every.join(best, keys, "left").select(
            *keys, F.coalesce("threshold", F.lit(0.5 if default is None else default)).alias("threshold"), "f1"
        )
    return _best_threshold(curve, keys, 0.5 if default is None else default)


def threshold_arrays(thresholds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, thresholds array in class order)."""
    entries = F.array_sort(F.collect_list(F.struct("k", "threshold")))
    return thresholds.groupBy(*by).agg(F.transform(entries, lambda e: e["threshold"]).alias("thresholds"))


def apply_thresholds(
    scores: DataFrame, thresholds: DataFrame, by: Sequence[str] = (), strict: bool = True, name: str = "pred"
) -> DataFrame:
    """Add the 0/1 prediction vector; thresholds are few rows and broadcast."""
    from tessella.functions.vectors import presence

    arrays = F.broadcast(threshold_arrays(thresholds, by))
    joined = scores.join(arrays, list(by)) if by else scores.crossJoin(arrays)
    return joined.withColumn(name, presence(F.col("scores"), F.col("thresholds"), strict)).drop("thresholds")


def predict_presence(
    scores: DataFrame, classes: Sequence[str], thresholds: DataFrame, default: float = 0.05
) -> DataFrame:
    """Decision by class name: (class, threshold) rows, missing classes use `default`."""
    listed = F.broadcast(
        thresholds.agg(F.map_from_entries(F.collect_list(F.struct("class", "threshold"))).alias("_m"))
    )
    names = F.array(*[F.lit(c) for c in classes])
    limits = F.transform(names, lambda c: F.coalesce(F.col("_m")[c], F.lit(default)))
    out = scores.crossJoin(listed).withColumn("_t", limits)
    return out.withColumn("pred", F.zip_with("scores", "_t", lambda s, t: (s > t).cast("int"))).drop("_m", "_t")


def score_grid(scores: DataFrame, n_grid: int = FIXED_GRID) -> DataFrame:
    """Confusion counts at every point of the fixed grid: the theta join, done by buckets."""
    return f1_curve(scores, "fixed", n_grid=n_grid)


def calibration_grid(scores: DataFrame, roles: Sequence[str] = ("val", "dev")) -> DataFrame:
    """(rule, k, threshold) for {role} x {q05, f1}; `scores` has a `role` column."""
    chosen = scores.where(F.col("role").isin(list(roles)))
    q = quantile_thresholds(chosen, 0.05, NEVER_FIRES, ["role"]).withColumn("rule", F.concat("role", F.lit("_q05")))
    f = argmax_f1_thresholds(chosen, "minmax", ["role"]).withColumn("rule", F.concat("role", F.lit("_f1")))
    return q.select("rule", "k", "threshold").unionByName(f.select("rule", "k", "threshold"))
