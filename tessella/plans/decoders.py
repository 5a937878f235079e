"""The three decoders as fit-and-evaluate jobs on a split image table.

`images` has image_id, combo, label and split; `tiles` has image_id, tile_idx, z. Every
job returns the fitted model and a long metric table (split, metric, value).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.model import ChannelModel, LinearModel, PrototypeModel
from tessella.operators import bags
from tessella.operators import calibrate as C
from tessella.operators import fit as fitting
from tessella.operators import metrics as M
from tessella.operators import prototypes as P
from tessella.operators import scoring as S
from tessella.session import durable


def image_scores(tiles: DataFrame, images: DataFrame, model, readout: str = "sims", extras: Sequence[str] = ()) -> DataFrame:
    """images plus `scores` (tile mean); images without tiles score zero. Only tiles of `images` are scored."""
    tiles = tiles.join(images.select("image_id"), "image_id", "left_semi")
    if isinstance(model, (ChannelModel, LinearModel)):
        tile = S.score_head(tiles, model)
        readout, extras = "sims", ()
    else:
        tile = S.score_tiles(tiles, model, (readout, *extras))
    pooled = S.tile_mean(tile, model.k, readout, extras=extras)
    return S.with_empty_images(pooled, images, model.k)


def labelled_tiles(tiles: DataFrame, images: DataFrame) -> DataFrame:
    """Tiles with their image's label vector as doubles, the input of the fits."""
    lab = images.select("image_id", F.transform("label", lambda x: x.cast("double")).alias("label"))
    return tiles.select("image_id", "tile_idx", "z").join(lab, "image_id")


def split_metrics(preds: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """(by, metric, value) from one bundle."""
    names = ["per_sample_f1", "macro_f1", "exact_match", "mean_predicted", "mean_true"]
    b = M.bundle(preds, list(by))
    entries = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
    return b.select(*by, F.explode(entries).alias("e")).select(*by, "e.metric", "e.value")


def calibrated(model, thresholds: DataFrame, unknown: float | None = None):
    """The model with its thresholds filled in (K numbers)."""
    rows = {r["k"]: r["threshold"] for r in thresholds.select("k", "threshold").collect()}
    values = tuple(float(rows[k]) if rows.get(k) is not None else None for k in range(model.k))
    return replace(model, thresholds=values, **({"unknown_threshold": unknown} if unknown is not None else {}))


def predict(scores: DataFrame, model, default: float = 0.05) -> DataFrame:
    """Add `pred` with the model's thresholds, strict comparison."""
    limits = [default if t is None else float(t) for t in model.thresholds]
    from tessella.functions.vectors import presence, vector_literal

    return scores.withColumn("pred", presence(F.col("scores"), vector_literal(limits)))


def run_matching(
    images: DataFrame, tiles: DataFrame, classes: Sequence[str], init: str = "auto", q: float = 0.05,
    unknown_q: float = 0.05, seed: int = 1337,
) -> tuple[PrototypeModel, DataFrame]:
    """Prototypes from train, thresholds and unknown threshold from val, metrics on val."""
    train, val = images.where("split = 'train'"), images.where("split = 'val'")
    model = P.init_prototypes(tiles, train, classes, init, seed)
    scores = image_scores(tiles, val, model, "sims", ("max_sim",))
    unknown = C.unknown_threshold(scores, "max_sim", unknown_q).first()[0]
    model = calibrated(model, C.quantile_thresholds(scores, q, C.FALLBACK_MATCH), unknown)
    return model, split_metrics(predict(scores, model))


def run_unmix(
    images: DataFrame, tiles: DataFrame, classes: Sequence[str], init: str = "auto", epochs: int = 0, lr: float = 1e-3,
    q: float = 0.05, unknown_q: float = 0.95, seed: int = 1337, **fit_args,
) -> tuple[PrototypeModel, DataFrame]:
    """Sparsemax unmixing: `epochs=0` stays at the initial prototypes (closed form)."""
    train, val = images.where("split = 'train'"), images.where("split = 'val'")
    model = P.init_prototypes(tiles, train, classes, init, seed)
    if epochs:
        rows = labelled_tiles(tiles, train)
        model = fitting.fit_unmix(rows if fit_args.get("absent_lambda") else rows.drop("label"), model, epochs, lr, **fit_args).model
    scores = image_scores(tiles, val, model, "weights", ("residual",))
    known = scores.withColumn("scores", F.slice("scores", 1, len(classes)))
    unknown = C.unknown_threshold(scores, "residual", unknown_q).first()[0]
    limits = C.quantile_thresholds(known, q, C.FALLBACK_UNMIX)
    model = calibrated(model, limits, unknown)
    named = replace(model, thresholds=model.thresholds[: len(classes)])
    return model, split_metrics(predict(known, named))


def run_channel_head(
    images: DataFrame, tiles: DataFrame, classes: Sequence[str], model: ChannelModel | None = None, **fit_args
) -> tuple[ChannelModel, DataFrame]:
    """Fit the channel heads (or take given weights), calibrate by best F1, evaluate val and test."""
    if model is None:
        rows = labelled_tiles(tiles, images.where("split = 'train'"))
        model, _ = fitting.fit_channel_head(rows, classes, **fit_args)
    scores = image_scores(tiles, images.where("split <> 'train'"), model)
    model = calibrated(model, C.argmax_f1_thresholds(scores.where("split = 'val'")))
    return model, split_metrics(predict(scores, model))


def detect_presence(model, images: DataFrame, tiles: DataFrame, readout: str = "sims") -> DataFrame:
    """Per-image scores and decisions of a fitted model: images + scores, pred."""
    return predict(image_scores(tiles, images, model, readout), model)


def run_linear_probe(
    images: DataFrame, tiles: DataFrame, classes: Sequence[str], lr_grid=(1e-2, 1e-1, 1.0), epochs: int = 30,
    seed: int = 1337,
) -> tuple[LinearModel, DataFrame]:
    """Linear heads; the rate is picked by validation F1, metrics under two threshold rules."""
    rows = labelled_tiles(tiles, images.where("split = 'train'"))
    val = images.where("split = 'val'")

    def validation(m: LinearModel) -> float:
        s = durable(image_scores(tiles, val, m).select("label", "scores"))
        return M.per_sample_f1(C.apply_thresholds(s, C.argmax_f1_thresholds(s, skip_empty=True))).first()[0]

    model, _, _ = fitting.fit_linear_probe(rows, classes, validation, lr_grid, epochs, seed=seed)
    scores = durable(image_scores(tiles, images.where("split <> 'train'"), model).select("split", "label", "scores"))
    v = scores.where("split = 'val'")
    out = None
    for rule, thr in (("f1", C.argmax_f1_thresholds(v, skip_empty=True)), ("q05", C.quantile_thresholds(v, 0.05, C.FALLBACK_MATCH))):
        part = split_metrics(C.apply_thresholds(scores, thr)).withColumn("rule", F.lit(rule))
        out = part if out is None else out.unionByName(part)
    return calibrated(model, C.argmax_f1_thresholds(v, skip_empty=True)), out


def run_mil(images: DataFrame, tiles: DataFrame, classes: Sequence[str], **fit_args):
    """Gated attention over tiles; best epoch by validation F1. Bags are made once for fitting and once for scoring."""
    train, judged = images.where("split = 'train'"), images.where("split <> 'train'")
    with fitting.held(bags.make_bags(tiles.join(judged.select("image_id"), "image_id", "left_semi")).join(judged.select("image_id", "split"), "image_id")) as own:

        def validation(m) -> float:
            s = images.join(bags.score_bags(own.where("split = 'val'"), m), "image_id")
            return M.per_sample_f1(C.apply_thresholds(s, C.argmax_f1_thresholds(s))).first()[0]

        rows = tiles.join(train.select("image_id"), "image_id", "left_semi")
        model, _ = fitting.fit_mil(rows, train, classes, validation=validation, **fit_args)
        scores = durable(judged.join(bags.score_bags(own, model), "image_id"))
    thr = C.argmax_f1_thresholds(scores.where("split = 'val'"))
    return model, split_metrics(C.apply_thresholds(scores, thr))


def compare_encoders(
    stores: dict[str, DataFrame], images: DataFrame, classes: Sequence[str], done: DataFrame | None = None, **probe_args
) -> DataFrame:
    """One linear probe per encoder's tile table; encoders already in `done` are skipped."""
    finished = {r["encoder"] for r in done.select("encoder").distinct().collect()} if done is not None else set()
    images = durable(images.select("image_id", "label", "split"))
    out = done
    for name, tiles in stores.items():
        if name in finished:
            continue
        _, table = run_linear_probe(images, tiles, classes, **probe_args)
        part = table.withColumn("encoder", F.lit(name))
        out = part if out is None else out.unionByName(part.select(*out.columns))
    return out
