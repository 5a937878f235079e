"""Decisions for folders of frames, in batch or as files arrive.

A frame's tiles are embedded, scored and averaged in one map, so one frame is one row
from start to end and no state or shuffle is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessella.functions.kernels import sigmoid, unit_rows
from tessella.functions.labels import class_names
from tessella.model import ChannelModel
from tessella.operators import frames as FR
from tessella.operators.scoring import readouts
from tessella.operators.splits import split_summary, temporal_split
from tessella.session import durable
from tessella.sources.files import IMAGE_SUFFIXES, list_images
from tessella.sources.manifests import write_images, write_manifest
from tessella.sources.stores import wide_predictions

DECISIONS = T.StructType([
    T.StructField("image", T.StringType()),
    T.StructField("scores", T.ArrayType(T.DoubleType())),
    T.StructField("evidence", T.DoubleType()),
    T.StructField("pred", T.ArrayType(T.IntegerType())),
    T.StructField("unknown", T.BooleanType()),
])


def frame_decisions(
    frames: DataFrame, model, encoder: FR.Encoder, size: int, n: int, readout: str = "sims", default: float = 0.05, **embed
) -> DataFrame:
    """(image, scores, evidence, pred, unknown) of (path, height, width, pixels) rows.

    `evidence` is the mean best similarity, or the mean residual for readout "weights";
    a channel head has no unknown decision.
    """
    limits = np.array([default if t is None else t for t in (model.thresholds or (None,) * model.k)])
    cutoff = getattr(model, "unknown_threshold", None)
    args = {"method": "divide", "border": "zero", **embed}

    def one(row):
        x = FR.flatten_of(FR.pixels_of(row), **args)
        z = unit_rows(encoder(FR.normalize_pixels(FR.cut(x, size, n))))
        if isinstance(model, ChannelModel):
            scores, evidence, unknown = sigmoid(model.logits(z)).mean(axis=0), None, None
        else:
            made = readouts(z, unit_rows(model.matrix), model.tau, (readout, "residual"))
            scores = made[readout].mean(axis=0)
            evidence = float((made["residual"] if readout == "weights" else made["max_sim"]).mean())
            unknown = None if cutoff is None else bool(evidence > cutoff if readout == "weights" else evidence < cutoff)
        yield dict(image=row.path, scores=scores, evidence=evidence, pred=(scores > limits[: len(scores)]).astype(np.int32), unknown=unknown)

    return FR.map_frames(frames.select("path", "height", "width", "pixels"), one, DECISIONS)


def infer_folder(spark, root: str, model, encoder: FR.Encoder, size: int, n: int, readout: str = "sims", **embed) -> DataFrame:
    """One wide row per image below `root`: evidence, unknown, score and presence per class."""
    made = frame_decisions(FR.decode_frames(spark, root), model, encoder, size, n, readout, **embed)
    prefix, evidence = ("weight", "residual_norm") if readout == "weights" else ("sim", "max_similarity")
    if isinstance(model, ChannelModel):
        return wide_predictions(made, model.classes, (), "score")
    return wide_predictions(made.withColumnRenamed("evidence", evidence), model.classes, (evidence, "unknown"), prefix)


def prepare(
    spark, root: str, manifest: str, train: float = 0.8, val: float = 0.1, suffixes: Sequence[str] = IMAGE_SUFFIXES, document: str | None = None
) -> DataFrame:
    """List `root`, split every folder by acquisition order, write the manifest, return counts.

    The manifest is Parquet, one folder per split; `document` asks for a JSON export as well.
    """
    if not 0 < train + val <= 1:
        raise ValueError("train and val must add up to at most 1")
    # written down, since the split goes over the listing three times
    images = durable(list_images(spark, root, suffixes, lengths=False).where("combo is not null").select("path", "combo"))
    split = temporal_split(images, train, val)
    write_images(split, manifest)
    split = spark.read.parquet(manifest)
    if document:
        write_manifest(split, class_names(images), document, {"train_frac": str(train), "val_frac": str(val)})
    return split_summary(split)
