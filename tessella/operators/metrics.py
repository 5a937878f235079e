"""Multi-label, open-set and discovery metrics.

Wide inputs carry `label` and `pred` arrays; per-image metrics are row expressions
followed by one aggregation, so nothing is shuffled by image. Rank metrics collapse equal
scores per group first and take running sums by cells (`operators.ordering`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.labels import combo_order
from tessella.operators.calibrate import long_scores
from tessella.operators.ordering import distinct_values, equal_count_bins, exact_quantiles, running


def _count_pairs(a: Column, b: Column, test) -> Column:
    return F.size(F.filter(F.zip_with(a, b, test), lambda x: x))


def sample_counts(pred="pred", label="label") -> tuple[Column, Column, Column]:
    p, y = F.col(pred), F.col(label)
    tp = _count_pairs(p, y, lambda a, b: (a == 1) & (b == 1))
    fp = _count_pairs(p, y, lambda a, b: (a == 1) & (b == 0))
    fn = _count_pairs(p, y, lambda a, b: (a == 0) & (b == 1))
    return tp, fp, fn


def sample_f1(pred="pred", label="label") -> Column:
    """2TP / (2TP + FP + FN) of one image; 1 when both sets are empty."""
    tp, fp, fn = sample_counts(pred, label)
    denom = 2 * tp + fp + fn
    return F.when(denom > 0, 2.0 * tp / denom).otherwise(F.lit(1.0))


def all_match(pred="pred", label="label") -> Column:
    return (F.col(pred) == F.col(label)).cast("int")


def per_sample_f1(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return preds.groupBy(*by).agg(F.avg(sample_f1()).alias("per_sample_f1"))


def exact_match(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return preds.groupBy(*by).agg(F.avg(all_match()).alias("exact_match"))


def cardinality(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    count = lambda c: F.size(F.filter(c, lambda v: v == 1))
    return preds.groupBy(*by).agg(
        F.avg(count("pred")).alias("mean_predicted"), F.avg(count("label")).alias("mean_true")
    )


def class_counts(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, k, tp, fp, fn, tn)."""
    long = preds.select(*by, F.posexplode(F.arrays_zip("pred", "label")).alias("k", "e"))
    hit = lambda p, y: F.sum(((F.col("e.pred") == p) & (F.col("e.label") == y)).cast("bigint"))
    return long.groupBy(*by, "k").agg(
        hit(1, 1).alias("tp"), hit(1, 0).alias("fp"), hit(0, 1).alias("fn"), hit(0, 0).alias("tn")
    )


def f1_of_counts() -> Column:
    denom = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return F.when(denom > 0, 2.0 * F.col("tp") / denom).otherwise(F.lit(0.0))


def class_f1(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return class_counts(preds, by).select(*by, "k", f1_of_counts().alias("f1"))


def macro_f1(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return class_f1(preds, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def confusion_rates(preds: DataFrame, by: Sequence[str] = (), empty: float | None = None) -> DataFrame:
    """(by, k, fpr, fnr, tpr, n_pos, n_neg); rates over nothing are `empty` (0.0 or NULL)."""
    counts = class_counts(preds, by)
    rate = lambda num, den: F.when(den > 0, F.col(num) / den).otherwise(F.lit(empty).cast("double"))
    pos, neg = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    return counts.select(
        *by,
        "k",
        rate("fp", neg).alias("fpr"),
        rate("fn", pos).alias("fnr"),
        rate("tp", pos).alias("tpr"),
        pos.alias("n_pos"),
        neg.alias("n_neg"),
    )


def separation(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean score on positives and negatives, and their difference (0 when one is empty)."""
    long = long_scores(scores, by)
    mean = lambda y: F.coalesce(F.avg(F.when(F.col("label") == y, F.col("score"))), F.lit(0.0))
    out = long.groupBy(*by, "k").agg(mean(1).alias("mean_pos"), mean(0).alias("mean_neg"))
    return out.withColumn("separation", F.col("mean_pos") - F.col("mean_neg"))


def constant_predictor(images: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Everything present: per-sample F1, macro F1, exact match, AUROC 0.5."""
    preds = images.select(*by, "label", F.transform("label", lambda _: F.lit(1)).alias("pred"))
    out = bundle(preds, by).withColumn("auroc_mean", F.lit(0.5))
    return out.select(*by, "per_sample_f1", "macro_f1", "exact_match", "auroc_mean")


def bundle(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per-sample F1, macro F1, exact match and cardinalities from one scan.

    Per-class counts ride along as K x 3 sums in the same aggregation.
    """
    count = lambda c: F.size(F.filter(c, lambda v: v == 1))
    k_count = F.max(F.size("label"))
    entries = F.posexplode(F.arrays_zip("pred", "label")).alias("k", "e")
    per_image = preds.select(
        *by,
        "pred",
        "label",
        sample_f1().alias("_f1"),
        all_match().alias("_em"),
        count("pred").alias("_np"),
        count("label").alias("_nt"),
    )
    long = per_image.select(*by, "_f1", "_em", "_np", "_nt", entries)
    hit = lambda p, y: F.sum(((F.col("e.pred") == p) & (F.col("e.label") == y)).cast("bigint"))
    per_class = long.groupBy(*by, "k").agg(
        hit(1, 1).alias("tp"),
        hit(1, 0).alias("fp"),
        hit(0, 1).alias("fn"),
        F.avg("_f1").alias("_f1"),
        F.avg("_em").alias("_em"),
        F.avg("_np").alias("_np"),
        F.avg("_nt").alias("_nt"),
    )
    return per_class.groupBy(*by).agg(
        F.max(F.when(F.col("k") == 0, F.col("_f1"))).alias("per_sample_f1"),
        F.avg(f1_of_counts()).alias("macro_f1"),
        F.max(F.when(F.col("k") == 0, F.col("_em"))).alias("exact_match"),
        F.max(F.when(F.col("k") == 0, F.col("_np"))).alias("mean_predicted"),
        F.max(F.when(F.col("k") == 0, F.col("_nt"))).alias("mean_true"),
    )


def margins(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """F1 and macro F1 minus those of the all-present predictor."""
    ones = preds.withColumn("pred", F.transform("label", lambda _: F.lit(1)))
    both = preds.select(*by, "pred", "label", F.lit(1).alias("_real")).unionByName(
        ones.select(*by, "pred", "label", F.lit(0).alias("_real"))
    )
    b = bundle(both, [*by, "_real"])
    sign = F.when(F.col("_real") == 1, 1.0).otherwise(-1.0)
    return b.groupBy(*by).agg(
        F.sum(sign * F.col("per_sample_f1")).alias("f1_margin"), F.sum(sign * F.col("macro_f1")).alias("macro_margin")
    )


def per_combo(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return preds.groupBy(*by, "combo").agg(
        F.count("*").alias("n"), F.avg(sample_f1()).alias("per_sample_f1"), F.avg(all_match()).alias("exact_match")
    )


# ---- rank metrics ----------------------------------------------------------------


def score_counts(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """(keys, score, pos, neg): one row per distinct score."""
    y = F.col(label).cast("bigint")
    return distinct_values(df, keys, score, pos=y, neg=F.lit(1) - y).drop("n")


def auroc(df: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """(keys, auroc) with average ranks for ties; NULL when one class is absent."""
    keys = list(keys)
    r = running(score_counts(df, keys, score, label), keys, score, ["pos", "neg"])
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / F.lit(2.0)))
    out = r.groupBy(*keys).agg(wins.alias("_u"), F.max("total_pos").alias("_p"), F.max("total_neg").alias("_n"))
    pairs = F.col("_p").cast("double") * F.col("_n")
    return out.select(*keys, F.when(pairs > 0, F.col("_u") / pairs).alias("auroc"))


def class_auroc(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return auroc(long_scores(scores, by), [*by, "k"])


def mean_auroc(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean over the classes where it is defined."""
    return class_auroc(scores, by).groupBy(*by).agg(F.avg("auroc").alias("auroc_mean"))


def roc_points(df: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """(keys, score, tp, fp, total_pos, total_neg) by descending score, ties collapsed."""
    keys = list(keys)
    r = running(score_counts(df, keys, score, label), keys, score, ["pos", "neg"], ascending=False)
    return r.select(
        *keys,
        score,
        (F.col("before_pos") + F.col("pos")).alias("tp"),
        (F.col("before_neg") + F.col("neg")).alias("fp"),
        "pos",
        "neg",
        "total_pos",
        "total_neg",
    )


def aupr(df: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Average precision: recall steps times precision. The step at a score is its own
    positives, so no neighbour lookup is needed."""
    keys = list(keys)
    pts = roc_points(df, keys, score, label)
    term = F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    out = pts.groupBy(*keys).agg(F.sum(term).alias("_s"), F.max("total_pos").alias("_p"))
    return out.select(*keys, F.when(F.col("_p") > 0, F.col("_s") / F.col("_p")).alias("aupr"))


def fpr_at_tpr(
    df: DataFrame,
    keys: Sequence[str] = (),
    targets: Sequence[float] = (0.95,),
    score: str = "score",
    label: str = "label",
) -> DataFrame:
    """(keys, target, fpr): false-positive rate at the first point reaching the target; 1.0
    when none does, NULL without negatives.

    Points on a straight run are kept, where some implementations thin them out.
    """
    keys = list(keys)
    pts = roc_points(df, keys, score, label).withColumn(
        "target", F.explode(F.array(*[F.lit(float(t)) for t in targets]))
    )
    reached = F.try_divide(F.col("tp"), F.col("total_pos")) >= F.col("target")
    rate = F.try_divide(F.col("fp"), F.col("total_neg"))
    out = pts.groupBy(*keys, "target").agg(F.min(F.when(reached, rate)).alias("fpr"), F.max("total_neg").alias("_n"))
    return out.select(*keys, "target", F.when(F.col("_n") > 0, F.coalesce("fpr", F.lit(1.0))).alias("fpr"))


def openset_metrics(
    df: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "unknown", target: float = 0.95
) -> DataFrame:
    """(keys, auroc, aupr, fpr95) from one pass over the ROC points; NULL if degenerate."""
    keys = list(keys)
    pts = roc_points(df, keys, score, label)
    p, n = F.col("total_pos"), F.col("total_neg")
    reached = F.try_divide(F.col("tp"), p) >= target
    # wins of the positives at a score over the negatives below it
    wins = F.col("pos") * (n - F.col("fp") + F.col("neg") / F.lit(2.0))
    out = pts.groupBy(*keys).agg(
        F.sum(wins).alias("_u"),
        F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))).alias("_ap"),
        F.min(F.when(reached, F.try_divide(F.col("fp"), n))).alias("_f"),
        F.max(p).alias("_p"),
        F.max(n).alias("_n"),
    )
    ok = (F.col("_p") > 0) & (F.col("_n") > 0)
    return out.select(
        *keys,
        F.when(ok, F.col("_u") / (F.col("_p").cast("double") * F.col("_n"))).alias("auroc"),
        F.when(ok, F.col("_ap") / F.col("_p")).alias("aupr"),
        F.when(ok, F.coalesce("_f", F.lit(1.0))).alias("fpr95"),
    )


def reliability(
    df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label", row_id: str = "image_id", bins: int = 10
) -> DataFrame:
    """(keys, bin, mean_score, frac_pos) over equal-count bins of ascending score."""
    binned = equal_count_bins(df, keys, score, row_id, bins)
    return binned.groupBy(*keys, "bin").agg(F.avg(score).alias("mean_score"), F.avg(label).alias("frac_pos"))


# ---- roll-ups --------------------------------------------------------------------


def _defined(col: str) -> Column:
    return F.when(~F.isnan(col), F.col(col))


def mean_std(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean, population deviation and count over defined (neither NULL nor NaN) values."""
    v = _defined(value)
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("n"))


def delta_by_seed(metrics: DataFrame, keys: Sequence[str] = ("method",), a: str = "val", b: str = "test") -> DataFrame:
    """Per seed a minus b, then mean and deviation; rows are (keys, seed, split, value)."""
    wide = metrics.groupBy(*keys, "seed").agg(
        F.max(F.when(F.col("split") == a, F.col("value"))).alias("_a"),
        F.max(F.when(F.col("split") == b, F.col("value"))).alias("_b"),
    )
    return mean_std(wide.withColumn("value", F.col("_a") - F.col("_b")), keys)


def delta_f1(preds: DataFrame, a: str = "val", b: str = "test") -> DataFrame:
    """In-distribution minus held-out per-sample F1; `preds` has `split`."""
    part = lambda s: F.avg(F.when(F.col("split") == s, sample_f1()))
    out = preds.agg(part(a).alias("f1_in"), part(b).alias("f1_out"))
    return out.withColumn("delta_f1", F.col("f1_in") - F.col("f1_out"))


def by_order(metrics: DataFrame, methods: Sequence[str], value: str = "per_sample_f1") -> DataFrame:
    """(order, <method>_mean, <method>_std, <method>_n); the raw part count is the order."""
    keyed = metrics.withColumn("order", combo_order("combo", strict=False))
    pick = lambda m: F.when(F.col("method") == m, F.col(value))
    aggs = []
    for m in methods:
        aggs += [F.avg(pick(m)).alias(f"{m}_mean"), F.stddev_pop(pick(m)).alias(f"{m}_std"), F.count(pick(m)).alias(f"{m}_n")]
    return keyed.groupBy("order").agg(*aggs)


def label_noise_bound(preds: DataFrame) -> DataFrame:
    """(k, fnr_singleton, fnr_mixture, n_*, upper_bound): miss rate on mixtures above that
    on pure cultures, floored at zero."""
    order = combo_order("combo", strict=False)
    long = preds.select(order.alias("_o"), F.posexplode(F.arrays_zip("pred", "label")).alias("k", "e"))
    miss = (F.col("e.pred") == 0).cast("int")
    on = lambda cond, v: F.when((F.col("e.label") == 1) & cond, v)
    single, mixed = F.col("_o") == 1, F.col("_o") > 1
    out = long.groupBy("k").agg(
        F.avg(on(single, miss)).alias("fnr_singleton"),
        F.count(on(single, F.lit(1))).alias("n_singleton"),
        F.avg(on(mixed, miss)).alias("fnr_mixture"),
        F.count(on(mixed, F.lit(1))).alias("n_mixture"),
    )
    gap = F.col("fnr_mixture") - F.col("fnr_singleton")
    return out.withColumn("upper_bound", F.when(gap.isNotNull(), F.greatest(gap, F.lit(0.0))))


def label_noise_summary(preds: DataFrame) -> DataFrame:
    return label_noise_bound(preds).agg(
        F.avg("upper_bound").alias("mean_upper_bound"), F.max("upper_bound").alias("max_upper_bound")
    )


def degradation(rows: DataFrame) -> DataFrame:
    """Mean F1 over severities minus the clean F1 of the same decoder and arm.

    Rows are (corruption, severity, decoder, arm, f1); the clean row is named `clean`.
    """
    clean = rows.where("corruption = 'clean'").select("decoder", "arm", F.col("f1").alias("_clean"))
    cells = rows.where("corruption <> 'clean'").groupBy("corruption", "decoder", "arm").agg(F.avg("f1").alias("_mean"))
    return cells.join(F.broadcast(clean), ["decoder", "arm"]).select(
        "corruption", "decoder", "arm", (F.col("_mean") - F.col("_clean")).alias("degradation")
    )


def flag_best(df: DataFrame, cols: Sequence[str], tol: float = 1e-6) -> DataFrame:
    """Add `best_<c>`: within `tol` of the column's maximum (a broadcast one-row aggregate)."""
    top = df.agg(*[F.max(c).alias(f"_m_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(top))
    for c in cols:
        out = out.withColumn(f"best_{c}", F.col(c) >= F.col(f"_m_{c}") - tol)
    return out.drop(*[f"_m_{c}" for c in cols])


def best_per(df: DataFrame, by: Sequence[str], metric: str, tie: str) -> DataFrame:
    """Best row of every group, smallest `tie` first on equal metric; NULL is below every metric.

    Two hash aggregations; the join between them is left to the optimizer, since groups
    may be many.
    """
    rest = [c for c in df.columns if c not in by]
    top = df.groupBy(*by).agg(F.max(metric).alias("_top"))
    tied = df.join(top, list(by)).where(F.col(metric).eqNullSafe(F.col("_top")))
    best = tied.groupBy(*by).agg(F.min_by(F.struct(*rest), F.col(tie)).alias("_b"))
    return best.select(*by, *[F.col(f"_b.{c}").alias(c) for c in rest])


def leaderboard(metrics: DataFrame, metric: str, tie: str, n: int | None = None) -> DataFrame:
    out = metrics.orderBy(F.col(metric).desc_nulls_last(), tie)
    return out.limit(n) if n else out


# ---- paired and transformed scores -----------------------------------------------


def tta_mean(scores: DataFrame, k: int, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Mean scores over the transforms of an image."""
    from tessella.operators.scoring import tile_mean

    return tile_mean(scores, k, "scores", by)


def pair_scores(scores: DataFrame, by: str = "transform") -> DataFrame:
    """(image_id, t1, t2, a, b) for t1 < t2: the transforms of an image are few, so they
    are gathered per image and paired there."""
    entry = F.array_sort(F.collect_list(F.struct(F.col(by).alias("t"), F.col("scores").alias("s"))))
    grouped = scores.groupBy("image_id").agg(entry.alias("e"))
    pairs = F.flatten(
        F.transform(
            "e",
            lambda x, i: F.transform(
                F.filter(F.col("e"), lambda _, j: j > i),
                lambda y: F.struct(x["t"].alias("t1"), y["t"].alias("t2"), x["s"].alias("a"), y["s"].alias("b")),
            ),
        )
    )
    return grouped.select("image_id", F.explode(pairs).alias("p")).select("image_id", "p.*")


def pairwise_l1(scores: DataFrame, by: str = "transform") -> DataFrame:
    """(t1, t2, l1): mean absolute score difference over images and classes."""
    gap = F.aggregate(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda t, v: t + v)
    return pair_scores(scores, by).groupBy("t1", "t2").agg((F.sum(gap) / F.sum(F.size("a"))).alias("l1"))


def paired_shift(a: DataFrame, b: DataFrame, own_thresholds: DataFrame) -> DataFrame:
    """Effect of a change on pure images, per class `k` = own class.

    Both inputs hold (image_id, k, scores); output has mean, minimum, pass rate, mean drop,
    margin change and arg-max rate on both sides.
    """
    from tessella.functions.vectors import own_is_best, own_margin

    own = lambda s: F.element_at(s, F.col("k") + 1)
    j = a.select("image_id", "k", F.col("scores").alias("_a")).join(
        b.select("image_id", F.col("scores").alias("_b")), "image_id"
    )
    j = j.join(F.broadcast(own_thresholds.select("k", "threshold")), "k")
    aggs = []
    for name, s in (("a", "_a"), ("b", "_b")):
        aggs += [
            F.avg(own(F.col(s))).alias(f"mean_{name}"),
            F.min(own(F.col(s))).alias(f"min_{name}"),
            F.avg((own(F.col(s)) > F.col("threshold")).cast("int")).alias(f"pass_{name}"),
            F.avg(own_margin(F.col(s), F.col("k"))).alias(f"margin_{name}"),
            F.avg(own_is_best(F.col(s), F.col("k")).cast("int")).alias(f"argmax_{name}"),
        ]
    out = j.groupBy("k").agg(*aggs)
    return out.withColumn("mean_drop", F.col("mean_a") - F.col("mean_b")).withColumn(
        "margin_change", F.col("margin_b") - F.col("margin_a")
    )


def class_references(
    pure_units: DataFrame, classes: Sequence[str], value: str, by: Sequence[str] = (), floor: float = 1e-6
) -> DataFrame:
    """(by, k, ref): lower median of pure-culture unit scores, at least `floor`.

    Rows are (by, k, value); classes without rows are absent and count as 1.0.
    """
    med = exact_quantiles(pure_units, [*by, "k"], value, [0.5], method="lower")
    return med.select(*by, "k", F.greatest(F.col(value), F.lit(floor)).alias("ref"))


def class_normalise(
    units: DataFrame, refs: DataFrame, value: str, nearest: str = "best", by: Sequence[str] = (), name: str | None = None
) -> DataFrame:
    """Unit score divided by the reference of its nearest known class (1.0 if none)."""
    r = F.broadcast(refs.select(*by, F.col("k").alias(nearest), "ref"))
    out = units.join(r, [*by, nearest], "left")
    return out.withColumn(name or f"{value}_norm", F.col(value) / F.coalesce("ref", F.lit(1.0))).drop("ref")
