"""Sweeps and ablations: one parameter varied, the rest of the job unchanged.

`images` has image_id, combo, label, split; `tiles` has image_id, tile_idx, z.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.vectors import is_central_tile
from tessella.model import PrototypeModel
from tessella.operators import calibrate as C
from tessella.operators import fit as fitting
from tessella.operators import frames as FR
from tessella.operators import metrics as M
from tessella.operators import multifit as MF
from tessella.operators import prototypes as P
from tessella.operators import scoring as S
from tessella.operators import splits as SP
from tessella.operators.isotonic import isotonic
from tessella.plans import decoders as D
from tessella.session import durable

COLUMNS = {"unmix": "weights", "match": "sims", "softmax": "softmax"}


def _union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _stacked(scored: DataFrame, k: int, methods: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by, method, scores): tile means of several read-outs from one aggregation."""
    flat = [F.avg(F.col(COLUMNS[m])[i]).alias(f"_{m}_{i}") for m in methods for i in range(k)]
    rows = F.array(*[F.struct(F.lit(m).alias("method"), F.array(*[F.col(f"_{m}_{i}") for i in range(k)]).alias("scores")) for m in methods])
    return scored.groupBy(*by).agg(*flat).select(*by, F.explode(rows).alias("e")).select(*by, "e.*")


def _calibrated_f1(scores: DataFrame, by: Sequence[str], q: float = 0.05, fallback=C.FALLBACK_UNMIX) -> DataFrame:
    """(by, per_sample_f1, macro_f1, exact_match) on test with thresholds from val."""
    scores = durable(scores)
    thr = C.quantile_thresholds(scores.where("split = 'val'"), q, fallback, by)
    preds = C.apply_thresholds(scores.where("split = 'test'"), thr, by)
    return M.bundle(preds, by).select(*by, "per_sample_f1", "macro_f1", "exact_match")


def _evaluated(images: DataFrame) -> DataFrame:
    return images.where("split <> 'train'").select("image_id", "combo", "label", "split")


def _judged(tiles, images: DataFrame):
    """The tiles of the images that are evaluated; the others are not scored."""
    return tiles.join(_evaluated(images).select("image_id"), "image_id", "left_semi")


def sweep_tile_count(images, tiles, model: PrototypeModel, counts=(1, 4, 8, 16), seed: int = 1337) -> DataFrame:
    """(t, method, metrics): up to t hash-drawn tiles per image; the draws are nested, so
    one rank per tile serves all counts."""
    h = F.md5(F.concat_ws(":", F.col("image_id").cast("string"), F.col("tile_idx").cast("string"), F.lit(str(seed))))
    from pyspark.sql.window import Window as W

    top = SP.subsample_tiles(_judged(tiles, images), max(counts), seed)
    ranked = top.withColumn("_r", F.row_number().over(W.partitionBy("image_id").orderBy(h, "tile_idx")))
    scored = S.score_tiles(ranked, model, ("sims", "weights"), ("image_id", "_r"))
    use = F.filter(F.array(*[F.lit(c) for c in counts]), lambda c: F.col("_r") <= c)
    scored = scored.select("image_id", "sims", "weights", F.explode(use).alias("t"))
    scores = _stacked(scored, model.k, ("unmix", "match"), ("t", "image_id")).join(_evaluated(images), "image_id")
    return _calibrated_f1(scores, ["t", "method"])


def sweep_quantile(images, tiles, model: PrototypeModel, qs=(0.01, 0.05, 0.10, 0.20)) -> DataFrame:
    """(q, method, metrics): all quantiles from one pass over the validation scores."""
    scored = S.score_tiles(_judged(tiles, images), model, ("sims", "weights"), ("image_id",))
    scores = durable(_stacked(scored, model.k, ("unmix", "match"), ("image_id",)).join(_evaluated(images), "image_id"))
    thr = C.quantile_thresholds(scores.where("split = 'val'"), list(qs), C.FALLBACK_UNMIX, ["method"])
    test = scores.where("split = 'test'").withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    return M.bundle(C.apply_thresholds(test, thr, ["method", "q"]), ["q", "method"]).select("q", "method", "per_sample_f1", "macro_f1", "exact_match")


def sweep_projection(images, tiles, model: PrototypeModel, epochs: int = 0, lr: float = 1e-3) -> DataFrame:
    """Sparsemax against softmax, optionally each with its own fit."""
    if not epochs:
        scored = S.score_tiles(_judged(tiles, images), model, ("weights", "softmax"), ("image_id",))
        scores = _stacked(scored, model.k, ("unmix", "softmax"), ("image_id",)).join(_evaluated(images), "image_id")
        return _calibrated_f1(scores, ["method"])
    train = tiles.join(images.where("split = 'train'").select("image_id"), "image_id", "left_semi")
    parts = []
    for method, activation in (("unmix", "sparsemax"), ("softmax", "softmax")):
        m = fitting.fit_unmix(train, model, epochs, lr, "element_mean", activation=activation).model
        s = S.tile_mean(S.score_tiles(_judged(tiles, images), m, (COLUMNS[method],), ("image_id",)), m.k, COLUMNS[method])
        parts.append(s.withColumn("method", F.lit(method)))
    return _calibrated_f1(_union(parts).join(_evaluated(images), "image_id"), ["method"])


def sweep_init(images, tiles, classes: Sequence[str], modes=("pure", "kmeans", "random"), seed: int = 1337) -> DataFrame:
    """(init, method, metrics) of every prototype initialisation, scored in one pass."""
    train = images.where("split = 'train'")
    mine = tiles.join(train.select("image_id"), "image_id", "left_semi")
    models = {i: P.init_prototypes(mine, train, classes, m, seed) for i, m in enumerate(modes)}
    scored = S.score_models(_judged(tiles, images), models, ("sims", "weights"), ("image_id",), "i")
    names = F.array(*[F.lit(m) for m in modes])
    scores = _stacked(scored, len(classes), ("unmix", "match"), ("i", "image_id")).withColumn("init", names[F.col("i")]).drop("i")
    return _calibrated_f1(scores.join(_evaluated(images), "image_id"), ["init", "method"])


def sweep_frames(images, frames, classes, encoder, arms: dict[str, dict]) -> DataFrame:
    """(arm, method, metrics) where an arm is a set of `embed_frames` arguments:
    illumination methods or tile sizes."""
    parts = []
    for name, args in arms.items():
        t = durable(FR.embed_frames(frames, encoder, **args))  # read for prototypes and for scores
        model = P.hybrid_prototypes(t, images.where("split = 'train'"), classes)
        s = _stacked(S.score_tiles(t, model, ("sims", "weights"), ("image_id",)), model.k, ("unmix", "match"), ("image_id",))
        parts.append(s.withColumn("arm", F.lit(name)))
    return _calibrated_f1(_union(parts).join(_evaluated(images), "image_id"), ["arm", "method"])


# ---- single ablations ------------------------------------------------------------


def boundary_tiles(images, tiles, model: PrototypeModel, grid: int = 4) -> DataFrame:
    """(tiles, metrics) with all tiles and with the central ones, thresholds for each."""
    scored = S.score_tiles(_judged(tiles, images), model, ("sims",))
    sets = F.filter(F.array(F.lit("all"), F.when(is_central_tile(F.col("tile_idx"), grid), "central")), lambda x: x.isNotNull())
    scored = scored.select("image_id", "sims", F.explode(sets).alias("tiles"))
    scores = S.tile_mean(scored, model.k, "sims", ("tiles", "image_id")).join(_evaluated(images), "image_id")
    return _calibrated_f1(scores, ["tiles"], fallback=C.NEVER_FIRES)


def invariance(frames, images, model: PrototypeModel, encoder, size: int, n: int, names=FR.TRANSFORMS, **embed_args):
    """Frozen model under frame transforms: (transform F1 incl. the mean of all, pairwise L1)."""
    t = durable(FR.embed_frames(frames, encoder, size, n, moves=names, **embed_args))  # so that encoder and scores do not hold workers side by side
    moved = S.tile_mean(S.score_tiles(t, model, ("sims",), ("image_id", "transform")), model.k, by=("image_id", "transform"))
    scores = durable(moved.select("image_id", "scores", "transform").join(images.select("image_id", "label"), "image_id"))
    mean = M.tta_mean(scores, model.k).join(images.select("image_id", "label"), "image_id").withColumn("transform", F.lit("mean_of_all"))
    preds = D.predict(scores.unionByName(mean.select(*scores.columns)), model)
    return M.bundle(preds, ["transform"]).select("transform", "per_sample_f1", "macro_f1"), M.pairwise_l1(scores)


def grayscale_shift(frames, images, model: PrototypeModel, encoder, size: int, n: int, per_class: int | None = None, **embed_args) -> DataFrame:
    """Effect of removing colour on pure images, per class (`metrics.paired_shift`)."""
    at = (F.array_position(F.array(*[F.lit(c) for c in model.classes]), F.col("combo")) - 1).cast("int")
    pure = images.withColumn("k", at).where("k >= 0")
    if per_class:
        pure = SP.cap_per_combo(pure, per_class)
    chosen = frames.join(pure.select("image_id"), "image_id", "left_semi")
    side = lambda fr: S.tile_mean(S.score_tiles(FR.embed_frames(fr, encoder, size, n, **embed_args), model, ("sims",)), model.k).join(pure.select("image_id", "k"), "image_id")
    gray = FR.transform_frames(chosen, ("grayscale",)).drop("transform")
    rows = [(k, float(t)) for k, t in enumerate(model.thresholds)]
    return M.paired_shift(side(chosen), side(gray), frames.sparkSession.createDataFrame(rows, "k int, threshold double"))


def isotonic_effect(scores: DataFrame, classes: Sequence[str]) -> DataFrame:
    """(variant, metrics, auroc_mean) on test: raw scores and isotonic recalibration fitted
    on val, thresholds by best F1 on val; `scores` has split."""
    val = scores.where("split = 'val'")
    both = scores.withColumn("variant", F.lit("raw")).unionByName(
        isotonic(val, scores, classes).select(*scores.columns).withColumn("variant", F.lit("isotonic"))
    )
    both = durable(both.select("variant", "split", "image_id", "label", "scores"))
    thr = C.argmax_f1_thresholds(both.where("split = 'val'"), by=["variant"])
    test = both.where("split = 'test'")
    b = M.bundle(C.apply_thresholds(test, thr, ["variant"]), ["variant"]).select("variant", "per_sample_f1", "macro_f1")
    return b.join(M.mean_auroc(test, ["variant"]), "variant")


def fit_sweep(images, tiles, classes: Sequence[str], variants: dict[str, dict], epochs: int = 10, lr: float = 1e-3) -> DataFrame:
    """(variant, metrics, proto_sim) of `fit_unmix` arguments: learned temperatures,
    repulsion strengths, absent-mass penalties."""
    start = P.hybrid_prototypes(tiles, images.where("split = 'train'"), classes)
    rows = durable(D.labelled_tiles(tiles, images.where("split = 'train'")))
    parts, sims = [], []
    for name, args in variants.items():
        m = fitting.fit_unmix(rows if args.get("absent_lambda") else rows.drop("label"), start, epochs, lr, **args).model
        s = S.tile_mean(S.score_tiles(_judged(tiles, images), m, ("weights",), ("image_id",)), m.k, "weights")
        parts.append(s.withColumn("variant", F.lit(name)))
        sims.append((name, P.mean_pairwise_sim(m)))
    f1 = _calibrated_f1(_union(parts).join(_evaluated(images), "image_id"), ["variant"], fallback=C.NEVER_FIRES)
    return f1.join(F.broadcast(tiles.sparkSession.createDataFrame(sims, "variant string, proto_sim double")), "variant")


def robustness(
    frames: DataFrame, images: DataFrame, models: dict[str, PrototypeModel], encoder, size: int, n: int,
    methods: Sequence[str] = ("divide", "none"), names: Sequence[tuple[str, int]] | None = None, **embed_args,
) -> DataFrame:
    """(corruption, severity, decoder, arm, f1) of frozen decoders under corrupted frames.

    `models` maps a decoder name (match, unmix) to a calibrated model; arms are the
    illumination methods at test time.
    """
    bad = FR.corrupt(frames, names)
    # condition and image in one id, so the embed step needs no extra columns
    listed = list(names) if names is not None else [("clean", 0)] + [(c, s) for c in FR.CORRUPTIONS for s in (1, 2, 3)]
    code = F.create_map(*[x for i, (c, s) in enumerate(listed) for x in (F.lit(f"{c}@{s}"), F.lit(i))])
    cell = code[F.concat("corruption", F.lit("@"), F.col("severity").cast("string"))]
    coded = bad.withColumn("image_id", F.col("image_id") * len(listed) + cell)
    parts = []
    for arm in methods:
        t = durable(FR.embed_frames(coded, encoder, size, n, method=arm, **embed_args))  # read by every decoder
        for decoder, model in models.items():
            s = S.tile_mean(S.score_tiles(t, model, (COLUMNS[decoder],)), model.k, COLUMNS[decoder])
            s = s.withColumn("cell", F.col("image_id") % len(listed)).withColumn("image_id", F.floor(F.col("image_id") / len(listed)).cast("bigint"))
            p = D.predict(s.join(images.select("image_id", "label"), "image_id"), model)
            f1 = p.groupBy("cell").agg(F.avg(M.sample_f1()).alias("f1"))
            parts.append(f1.withColumn("decoder", F.lit(decoder)).withColumn("arm", F.lit(arm)))
    back = F.array(*[F.struct(F.lit(c).alias("corruption"), F.lit(s).alias("severity")) for c, s in listed])
    return _union(parts).withColumn("e", back[F.col("cell").cast("int")]).select("e.corruption", "e.severity", "decoder", "arm", "f1")


POOLS = ("real", "mosaic", "real+mosaic")


def mosaic_stage(real: DataFrame, synthetic: DataFrame, images, tiles, classes, epochs: int = 10, lr: float = 1e-3, **fit_args) -> DataFrame:
    """(pool, metrics): unmixing fitted on real, mosaic, and both unit pools.

    Pools hold (image_id, tile_idx, z, label); the union holds every unit of both. The three fits share every
    pass, unless `fit_args` has what `multifit.UnmixJob` does not know; the tiles are scored in one pass.
    """
    units = lambda df: df.select("image_id", "tile_idx", "z", "label")
    start = P.hybrid_prototypes(tiles, images.where("split = 'train'"), classes)
    if set(fit_args) <= {"absent_lambda", "reduction", "activation"}:
        member = lambda pool: F.array(*[F.lit(float(pool in name.split("+"))) for name in POOLS])
        rows = units(real).withColumn("member", member("real")).unionByName(units(synthetic).withColumn("member", member("mosaic")))
        models = MF.fit_together(rows, {name: MF.UnmixJob(start, lr=lr, **fit_args) for name in POOLS}, epochs)
    else:
        pools = {"real": real, "mosaic": synthetic, "real+mosaic": units(real).unionByName(units(synthetic))}
        models = {name: fitting.fit_unmix(pools[name], start, epochs, lr, **fit_args).model for name in POOLS}
    scored = S.score_models(_judged(tiles, images), {i: models[name] for i, name in enumerate(POOLS)}, ("weights",), ("image_id",), "i")
    scores = S.tile_mean(scored, start.k, "weights", ("i", "image_id")).withColumn("pool", F.array(*[F.lit(name) for name in POOLS])[F.col("i")]).drop("i")
    return _calibrated_f1(scores.join(_evaluated(images), "image_id"), ["pool"], fallback=C.NEVER_FIRES)


def subspace_stage(images, tiles, classes, dims=(32,), epochs: int = 10, lr: float = 1e-3, absent_lambda: float = 1.0) -> DataFrame:
    """(d, metrics) of unmixing inside a fitted orthonormal subspace."""
    train = images.where("split = 'train'")
    start = P.hybrid_prototypes(tiles, train, classes)
    rows = durable(D.labelled_tiles(tiles, train))
    parts = []
    for dim in dims:
        fitted = fitting.fit_subspace(rows, start, P.pca_basis(rows, dim), epochs, lr, absent_lambda)
        projected = S.project(S.normalize_tiles(_judged(tiles, images)), fitted.w)
        parts.append(S.tile_mean(S.score_tiles(projected, fitted.model, ("weights",)), len(classes), "weights").withColumn("d", F.lit(dim)))
    return _calibrated_f1(_union(parts).join(_evaluated(images), "image_id"), ["d"], fallback=C.NEVER_FIRES)
