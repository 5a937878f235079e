"""Leave-combinations-out jobs: several seeds or folds in one pass over the tiles."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.kernels import sparsemax_rows, unit_rows
from tessella.model import ChannelModel, PrototypeModel
from tessella.operators import calibrate as C
from tessella.operators import intervals as I
from tessella.operators import metrics as M
from tessella.operators import multifit as MF
from tessella.operators import prototypes as P
from tessella.operators import scoring as S
from tessella.operators import splits as SP
from tessella.session import durable

READOUTS = {"match": "sims", "unmix": "weights"}


def seed_splits(images: DataFrame, counts: dict[int, int], seeds: Sequence[int]) -> DataFrame:
    """(image_id, combo, label, split, seed): one partition per seed."""
    parts = [
        SP.lco_split(images, SP.select_heldout(images, counts, s), s).withColumn("seed", F.lit(int(s))) for s in seeds
    ]
    return reduce(DataFrame.unionByName, parts).select("image_id", "combo", "label", "split", "seed")


def evaluate_lco(
    images: DataFrame, tiles: DataFrame, classes: Sequence[str], seeds: Sequence[int] = (1337,),
    counts: dict[int, int] = SP.HELDOUT_COUNTS, methods: Sequence[str] = ("match", "unmix"), q: float = 0.05,
) -> DataFrame:
    """Predictions of closed-form decoders on validation and held-out combinations.

    Returns (seed, method, split, image_id, combo, label, scores, pred). Prototypes of all
    seeds come from one scan, scores of all seeds from another.
    """
    split = durable(seed_splits(images, counts, seeds))
    train = split.where("split = 'train'")
    models = {s[0]: m for s, m in P.prototypes_by(tiles, train, classes, ["seed"]).items()}
    outputs = [READOUTS[m] for m in methods]
    wanted = split.where("split <> 'train'").select("image_id").distinct()
    scored = S.score_models(tiles.join(wanted, "image_id", "left_semi"), models, outputs, ("image_id",), "seed")
    k = len(classes)
    flat = [F.avg(F.col(o)[i]).alias(f"_{m}_{i}") for m, o in zip(methods, outputs) for i in range(k)]
    wide = scored.groupBy("seed", "image_id").agg(*flat)
    entries = F.array(*[
        F.struct(F.lit(m).alias("method"), F.array(*[F.col(f"_{m}_{i}") for i in range(k)]).alias("scores")) for m in methods
    ])
    scores = wide.select("seed", "image_id", F.explode(entries).alias("e")).select("seed", "image_id", "e.*")
    out = split.where("split <> 'train'").join(scores, ["seed", "image_id"])
    thr = C.quantile_thresholds(out.where("split = 'val'"), q, C.NEVER_FIRES, ["seed", "method"])
    return C.apply_thresholds(out, thr, ["seed", "method"])


def lco_report(preds: DataFrame) -> DataFrame:
    """(seed, method, split, scope, key, n, per_sample_f1, exact_match): totals and combinations."""
    keys = ["seed", "method", "split"]
    agg = [F.count("*").alias("n"), F.avg(M.sample_f1()).alias("per_sample_f1"), F.avg(M.all_match()).alias("exact_match")]
    total = preds.groupBy(*keys).agg(*agg).select(*keys, F.lit("total").alias("scope"), F.lit("").alias("key"), "n", "per_sample_f1", "exact_match")
    per = preds.groupBy(*keys, "combo").agg(*agg).select(*keys, F.lit("combo").alias("scope"), F.col("combo").alias("key"), "n", "per_sample_f1", "exact_match")
    return total.unionByName(per)


def seed_rollup(report: DataFrame) -> DataFrame:
    """(method, quantity, mean, std, n) over seeds, with val minus test as `delta`."""
    total = report.where("scope = 'total'").select("method", "seed", "split", F.col("per_sample_f1").alias("value"))
    per = M.mean_std(total.withColumn("quantity", F.col("split")), ["method", "quantity"])
    delta = M.delta_by_seed(total).withColumn("quantity", F.lit("delta"))
    return per.unionByName(delta.select(*per.columns))


def _fold_models(images: DataFrame, tiles: DataFrame, folds: DataFrame, classes: Sequence[str], n_folds: int) -> dict[int, PrototypeModel]:
    """Closed-form prototypes of the training part of every fold, from one scan: per-combination sums are combined per fold."""
    per_combo = durable(P.combo_sums(tiles, images))
    train = SP.expand_folds(per_combo, folds, n_folds).where("role = 'train'").drop("role")
    rows: dict[int, list] = {}
    for r in P.choose_source(P.combo_to_class_sums(train, classes, ["fold"]), ["fold"]).collect():
        rows.setdefault(r["fold"], []).append(r)
    return {f: P._to_model(rs, classes, 10.0) for f, rs in sorted(rows.items())}


def _pooled_folds(scores: DataFrame, folds: DataFrame, thresholds: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Development rows of every fold with the decisions of its own thresholds, set on its training rows; `scores` has key and fold."""
    mine = F.broadcast(folds.select("combo", F.col("fold").alias("_dev")))
    tagged = scores.join(mine, "combo", "left").withColumn("is_dev", F.coalesce(F.col("_dev") == F.col("fold"), F.lit(False)))
    dev = tagged.where("is_dev").drop("_dev", "is_dev")
    return C.apply_thresholds(dev, thresholds(tagged.where("not is_dev")), ["key", "fold"])


def nested_cv(
    images: DataFrame, tiles: DataFrame, classes: Sequence[str], n_folds: int = 5, seed: int = 1337,
    aggs: Sequence[str] = S.AGGREGATIONS, readouts: Sequence[str] = ("cosine", "sparsemax"), q: float = 0.05,
) -> DataFrame:
    """Pooled development predictions of every fold: (key, fold, image_id, combo, label, scores, pred).

    Fold prototypes come from one scan, and all read-outs and aggregations of all folds from
    another.
    """
    im = images.select("image_id", "combo", "label")
    folds = durable(SP.build_folds(im, n_folds, seed))
    scores = S.score_units_by(tiles, _fold_models(im, tiles, folds, classes, n_folds), aggs)
    scores = scores.where(F.split("key", "/")[0].isin(list(readouts))).drop("residual")
    scores = durable(scores.join(im, "image_id"))
    return _pooled_folds(scores, folds, lambda s: C.quantile_thresholds(s, q, C.NEVER_FIRES, ["key", "fold"]))


def nested_cv_granularities(images: DataFrame, units: DataFrame, classes: Sequence[str], **args) -> DataFrame:
    """`nested_cv` of every granularity of `units` (granularity, image_id, z); `key` starts with its name. Images, and so folds, are the same for all."""
    names = sorted(r[0] for r in units.select("granularity").distinct().collect())
    parts = [nested_cv(images, units.where(F.col("granularity") == g).drop("granularity"), classes, **args).withColumn("key", F.concat(F.lit(f"{g}/"), "key")) for g in names]
    return reduce(DataFrame.unionByName, parts)


#: Decoders of the fitted cross-validation and how their thresholds are set.
FITTED = ("simplex", "prototype", "channel")


def fit_folds(
    images: DataFrame, tiles: DataFrame, folds: DataFrame, classes: Sequence[str], models: dict[int, PrototypeModel],
    epochs: int = 30, lr: float = 1e-3, head_lr: float = 1e-2, drop: float = 0.5, tolerance: float | None = None,
) -> tuple[dict[int, PrototypeModel], dict[int, ChannelModel]]:
    """Unmixing prototypes and channel heads of every fold, each on all rows but the fold's own; one pass over the rows an epoch for all of them."""
    im = images.select("image_id", "combo", "label").join(F.broadcast(folds.select("combo", F.col("fold").alias("_dev"))), "combo", "left")
    rows = tiles.select("image_id", "tile_idx", "z").join(im.select("image_id", "label", "_dev"), "image_id")
    dim = next(iter(models.values())).dim
    jobs = {("simplex", f): MF.UnmixJob(m, lr=lr) for f, m in models.items()}
    jobs |= {("channel", f): MF.ChannelJob(tuple(classes), dim, lr=head_lr, drop=drop) for f in models}
    member = MF.member_of([F.col("_dev").isNull() | (F.col("_dev") != f) for _, f in jobs])
    done = MF.fit_together(rows.withColumn("member", member), jobs, epochs, tolerance)
    return {f: done["simplex", f] for f in models}, {f: done["channel", f] for f in models}


def nested_cv_fitted(
    images: DataFrame, tiles: DataFrame, classes: Sequence[str], n_folds: int = 5, seed: int = 1337, q: float = 0.05, **fit_args,
) -> DataFrame:
    """Pooled development predictions of three decoders in every fold: (key, fold, image_id, combo, label, scores, pred).

    `simplex` are fitted unmixing weights, `prototype` cosines to the closed-form prototypes,
    `channel` fitted channel heads; scores are tile means. Thresholds are set on a fold's
    training images: q-quantiles of the positives, best F1 for the heads. `fit_args` go to
    `fit_folds`.
    """
    im = images.select("image_id", "combo", "label")
    folds = durable(SP.build_folds(im, n_folds, seed))
    models = _fold_models(im, tiles, folds, classes, n_folds)
    fitted, heads = fit_folds(im, tiles, folds, classes, models, **fit_args)
    readers = {}
    for f, m in models.items():
        closed, own, tau = unit_rows(np.asarray(m.matrix)), fitted[f].matrix, m.tau
        readers[3 * f] = lambda z, p=own, t=tau: sparsemax_rows(z @ p.T * t)
        readers[3 * f + 1] = lambda z, p=closed: z @ p.T
        readers[3 * f + 2] = MF.channel_reader(heads[f])
    mean = S.tile_mean(MF.score_together(tiles, readers), len(classes), "scores", ("cell", "image_id"))
    name = F.array(*[F.lit(x) for x in FITTED])[F.col("cell") % 3]
    scores = mean.select(name.alias("key"), F.floor(F.col("cell") / 3).cast("int").alias("fold"), "image_id", "scores")
    scores = durable(scores.join(im, "image_id"))

    def thresholds(train: DataFrame) -> DataFrame:
        by = ["key", "fold"]
        quantile = C.quantile_thresholds(train.where("key <> 'channel'"), q, C.NEVER_FIRES, by)
        best = C.argmax_f1_thresholds(train.where("key = 'channel'"), by=by)
        return quantile.select(*by, "k", "threshold").unionByName(best.select(*by, "k", "threshold"))

    return _pooled_folds(scores, folds, thresholds)


def nested_cv_report(preds: DataFrame, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """(key, metric, point, lo, hi, resolved): pooled over folds, resampled by combination."""
    preds = durable(preds)
    out = None
    for key in sorted(r["key"] for r in preds.select("key").distinct().collect()):
        part = I.bootstrap_report(preds.where(F.col("key") == key), n_boot=n_boot, seed=seed).withColumn("key", F.lit(key))
        out = part if out is None else out.unionByName(part)
    return out


def granularity_report(
    units: DataFrame, protocol: DataFrame, classes: Sequence[str], aggs: Sequence[str] = S.AGGREGATIONS
) -> DataFrame:
    """(granularity, key, role, auroc_mean, per_sample_f1): closed-form read-outs per unit kind.

    `units` has granularity, image_id, z; `protocol` has image_id, combo, label, role.
    Prototypes use the train role, thresholds the val role.
    """
    protocol = durable(protocol.select("image_id", "combo", "label", "role"))
    keys = ["granularity", "key"]
    judged = protocol.where("role <> 'train'")
    parts = [
        S.score_units(_units_of(units, name, judged), model, aggs).withColumn("granularity", F.lit(name))
        for name, model in _granularity_models(units, protocol, classes).items()
    ]
    scores = durable(reduce(DataFrame.unionByName, parts).join(judged, "image_id"))
    thr = C.quantile_thresholds(scores.where("role = 'val'"), 0.05, C.NEVER_FIRES, keys)
    f1 = M.per_sample_f1(C.apply_thresholds(scores, thr, keys), [*keys, "role"])
    return M.mean_auroc(scores, [*keys, "role"]).join(f1, [*keys, "role"])


def _units_of(units: DataFrame, granularity: str, images: DataFrame) -> DataFrame:
    """Units of one granularity and the given images alone."""
    return units.where(F.col("granularity") == granularity).join(images.select("image_id"), "image_id", "left_semi")


def _granularity_models(units: DataFrame, protocol: DataFrame, classes: Sequence[str]) -> dict[str, PrototypeModel]:
    """Closed-form prototypes of every granularity on the train role. Units are added up by image in their tasks, so a vector an image and granularity meets its combination."""
    train = protocol.where("role = 'train'").select("image_id", "combo")
    names = sorted(r[0] for r in units.select("granularity").distinct().collect())  # a few kinds
    parts = [P.image_sums(units.where(F.col("granularity") == g)).withColumn("granularity", F.lit(g)) for g in names]
    sums = reduce(DataFrame.unionByName, parts).join(train, "image_id")
    per = P.add_vectors(P.partial_sums(sums, ["combo", "granularity"], "s", unit=False, count="n"), ["combo", "granularity"])
    rows: dict[str, list] = {}
    for r in P.choose_source(P.combo_to_class_sums(per, classes, ["granularity"]), ["granularity"]).collect():
        rows.setdefault(r["granularity"], []).append(r)
    return {g: P._to_model(rs, classes, 10.0) for g, rs in sorted(rows.items())}


def select_on_dev(report: DataFrame, metric: str = "auroc_mean") -> DataFrame:
    """Best (granularity, key) on the development role."""
    dev = report.where("role = 'dev'").withColumn("name", F.concat_ws("/", "granularity", "key"))
    return M.leaderboard(dev, metric, "name", 1)


#: Variants of the trained stage and their weight on classes that an image does not have.
VARIANTS = {"mse": 0.0, "absent": 1.0}


def granularity_stage(
    units: DataFrame, protocol: DataFrame, classes: Sequence[str], granularities: Sequence[str] | None = None,
    variants: dict[str, float] = VARIANTS, aggs: Sequence[str] = S.AGGREGATIONS, epochs: int = 30, lr: float = 1e-3,
    q: float = 0.05, tolerance: float | None = None,
) -> DataFrame:
    """(granularity, variant, key, dev_auroc, test_auroc, test_f1, test_macro_f1, test_exact, test_mean_predicted, test_f1_dev).

    Unmixing prototypes are trained for every granularity and variant at once, from the
    closed-form ones, on the train role; without `granularities`, on the one that closed-form
    read-outs select on the dev role. Thresholds are q-quantiles on val, and for the last column on dev.
    Arguments are those of `granularity_report`.
    """
    protocol = durable(protocol.select("image_id", "combo", "label", "role"))
    if granularities is None:
        granularities = [select_on_dev(granularity_report(units, protocol, classes, aggs)).first()["granularity"]]
    units = units.where(F.col("granularity").isin(list(granularities)))
    models = _granularity_models(units, protocol, classes)
    jobs = {(g, v): MF.UnmixJob(models[g], lam, lr=lr) for g in granularities for v, lam in variants.items()}
    rows = units.join(protocol.where("role = 'train'").select("image_id", "label"), "image_id")
    rows = rows.withColumn("member", MF.member_of([F.col("granularity") == g for g, _ in jobs]))
    fits = MF.fit_together(rows, jobs, epochs, tolerance)
    judged = protocol.where("role <> 'train'")
    names = list(variants)
    parts = [
        S.score_units_by(_units_of(units, g, judged), {i: fits[g, v] for i, v in enumerate(names)}, aggs, name="_v").withColumn("granularity", F.lit(g))
        for g in granularities
    ]
    scores = reduce(DataFrame.unionByName, parts).withColumn("variant", F.array(*[F.lit(v) for v in names])[F.col("_v")]).drop("_v", "residual")
    scores = durable(scores.join(judged, "image_id"))
    return stage_report(scores, ["granularity", "variant", "key"], q)


def stage_report(scores: DataFrame, keys: Sequence[str], q: float = 0.05) -> DataFrame:
    """(keys, dev_auroc, test_auroc, test metrics): thresholds from val, and from dev for `test_f1_dev`; `scores` has a role."""
    keys = list(keys)
    test = scores.where("role = 'test'")
    cut = lambda role: C.apply_thresholds(test, C.quantile_thresholds(scores.where(F.col("role") == role), q, C.NEVER_FIRES, keys), keys)
    auroc = M.mean_auroc(scores.where("role in ('dev', 'test')"), [*keys, "role"])
    auroc = auroc.groupBy(*keys).agg(*[F.max(F.when(F.col("role") == r, F.col("auroc_mean"))).alias(f"{r}_auroc") for r in ("dev", "test")])
    names = {"per_sample_f1": "test_f1", "macro_f1": "test_macro_f1", "exact_match": "test_exact", "mean_predicted": "test_mean_predicted"}
    own = M.bundle(cut("val"), keys).select(*keys, *[F.col(a).alias(b) for a, b in names.items()])
    other = M.per_sample_f1(cut("dev"), keys).withColumnRenamed("per_sample_f1", "test_f1_dev")
    return auroc.join(own, keys).join(other, keys)


def select_stage(report: DataFrame) -> DataFrame:
    """The run with the best dev AUROC of a `granularity_stage`."""
    return M.leaderboard(report.withColumn("name", F.concat_ws("/", "granularity", "variant", "key")), "dev_auroc", "name", 1)


def calibration_stage(scores: DataFrame, test_role: str = "test") -> DataFrame:
    """(rule, split metrics on test) for {val, dev} x {q05, f1}; `scores` has a role."""
    from tessella.plans.decoders import split_metrics

    thr = C.calibration_grid(scores)
    rules = thr.select("rule").distinct()
    test = scores.where(F.col("role") == test_role).crossJoin(F.broadcast(rules))
    return split_metrics(C.apply_thresholds(test, thr, ["rule"]), ["rule"])
