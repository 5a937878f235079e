"""Tiles against class parameters, and aggregation of tiles to images.

Tile scoring is a map over Arrow batches: no shuffle, the parameters are in the
closure. Tile to image is one hash aggregation with K (or K + 1) partial averages, so a
tile leaves its map task only as part of a partial sum.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.kernels import (
    energy_rows,
    sigmoid,
    softmax_rows,
    sparsemax_rows,
    to_lists,
    to_matrix,
    unit_rows,
)
from tessella.model import ChannelModel, LinearModel, PrototypeModel

VECTORS = ("sims", "weights", "softmax")
AGGREGATIONS = ("mean", "q90", "max")


def _map_vectors(df: DataFrame, vec: str, keep: Sequence[str], outputs: dict[str, T.DataType], fn) -> DataFrame:
    """Arrow map that keeps `keep` and adds the arrays `fn(matrix)` returns by name."""
    schema = T.StructType(
        [df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in outputs.items()]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            made = fn(to_matrix(b.column(vec)))
            cols = [b.column(c) for c in keep]
            for name in outputs:
                v = made[name]
                cols.append(to_lists(v) if v.ndim == 2 else pa.array(v))
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *outputs])

    return df.select(*dict.fromkeys([*keep, vec])).mapInArrow(run, schema)


def readouts(z: np.ndarray, p: np.ndarray, tau, wanted: Sequence[str]) -> dict[str, np.ndarray]:
    """Read-outs of unit rows against unit prototypes."""
    s = z @ p.T
    out: dict[str, np.ndarray] = {"sims": s, "max_sim": s.max(axis=1)}
    if {"weights", "residual"} & set(wanted):
        out["weights"] = sparsemax_rows(s * tau)
        out["residual"] = np.linalg.norm(z - out["weights"] @ p, axis=1)
    if "softmax" in wanted:
        out["softmax"] = softmax_rows(s * tau)
    out["neg_max"] = -out["max_sim"]
    out["best"] = s.argmax(axis=1).astype(np.int32)
    for name in wanted:
        if name.startswith("energy@"):
            out[name] = energy_rows(s, float(name.split("@")[1]))
    return out


def score_tiles(
    tiles: DataFrame,
    model: PrototypeModel,
    outputs: Sequence[str] = ("sims",),
    keep: Sequence[str] = ("image_id", "tile_idx"),
    vec: str = "z",
) -> DataFrame:
    """Per-tile read-outs.

    `outputs` may name: sims, weights (sparsemax of tau * sims), softmax, residual,
    max_sim, best (arg-max class), neg_max, or energy@T for a temperature T.
    """
    p = unit_rows(np.asarray(model.matrix, dtype=np.float64))
    tau = model.tau
    wanted = list(outputs)

    def dtype(name: str) -> T.DataType:
        if name in VECTORS:
            return T.ArrayType(T.DoubleType())
        return T.IntegerType() if name == "best" else T.DoubleType()

    compute = lambda z: readouts(unit_rows(z), p, tau, wanted)
    return _map_vectors(tiles, vec, keep, {n: dtype(n) for n in wanted}, compute)


def score_head(
    tiles: DataFrame,
    model: ChannelModel | LinearModel,
    keep: Sequence[str] = ("image_id", "tile_idx"),
    vec: str = "z",
) -> DataFrame:
    """Sigmoid scores of a linear head on unit vectors."""
    fn = lambda z: {"sims": sigmoid(model.logits(unit_rows(z)))}
    return _map_vectors(tiles, vec, keep, {"sims": T.ArrayType(T.DoubleType())}, fn)


def project(tiles: DataFrame, w: np.ndarray, keep=("image_id", "tile_idx"), vec: str = "z") -> DataFrame:
    """normalise(W z) for a (d, D) projection."""
    fn = lambda z: {vec: unit_rows(z @ w.T)}
    return _map_vectors(tiles, vec, keep, {vec: T.ArrayType(T.DoubleType())}, fn)


def normalize_tiles(tiles: DataFrame, keep=("image_id", "tile_idx"), vec: str = "z") -> DataFrame:
    return _map_vectors(tiles, vec, keep, {vec: T.ArrayType(T.DoubleType())}, lambda z: {vec: unit_rows(z)})


def tile_mean(
    scored: DataFrame, k: int, column: str = "sims", by: Sequence[str] = ("image_id",), extras: Sequence[str] = ()
) -> DataFrame:
    """(by, scores, extras): element-wise mean over the tiles of an image."""
    aggs = [F.avg(F.col(column)[i]).alias(f"_s{i}") for i in range(k)]
    aggs += [F.avg(f"`{c}`").alias(c) for c in extras]
    out = scored.groupBy(*by).agg(*aggs)
    return out.select(
        *by, F.array(*[F.col(f"_s{i}") for i in range(k)]).alias("scores"), *[F.col(f"`{c}`") for c in extras]
    )


def with_empty_images(scores: DataFrame, images: DataFrame, k: int) -> DataFrame:
    """Images that have no tile get zero scores."""
    zero = F.array(*[F.lit(0.0)] * k)
    return images.join(scores, "image_id", "left").withColumn("scores", F.coalesce("scores", zero))


def tile_max(scored: DataFrame, k: int, column: str = "sims", by: Sequence[str] = ("image_id",)) -> DataFrame:
    out = scored.groupBy(*by).agg(*[F.max(F.col(column)[i]).alias(f"_s{i}") for i in range(k)])
    return out.select(*by, F.array(*[F.col(f"_s{i}") for i in range(k)]).alias("scores"))


def tile_quantile(
    scored: DataFrame,
    k: int,
    q: float,
    column: str = "sims",
    by: Sequence[str] = ("image_id",),
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """Exact element-wise quantile over the units of an image, linear interpolation.

    The `percentile` aggregate keeps an image's values in one task, which is fine for the
    usual tens to thousands of units. Images above `hot_rows` units (few, since each
    takes that many rows) go through the distributed order statistics instead.
    """
    by = list(by)
    hot = scored.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).select(*by)
    hot = F.broadcast(hot)  # at most (all units / hot_rows) rows
    usual = scored.join(hot, by, "left_anti")
    usual = usual.groupBy(*by).agg(*[F.percentile(F.col(column)[i], q).alias(f"_s{i}") for i in range(k)])
    usual = usual.select(*by, F.array(*[F.col(f"_s{i}") for i in range(k)]).alias("scores"))
    return usual.unionByName(_long_quantile(scored.join(hot, by, "left_semi"), q, column, by))


def aggregate_tiles(
    scored: DataFrame, k: int, agg: str, column: str = "sims", by: Sequence[str] = ("image_id",)
) -> DataFrame:
    """mean, max, or qNN (for example q90)."""
    if agg == "mean":
        return tile_mean(scored, k, column, by)
    if agg == "max":
        return tile_max(scored, k, column, by)
    if agg.startswith("q"):
        return tile_quantile(scored, k, int(agg[1:]) / 100.0, column, by)
    raise ValueError(f"unknown aggregation {agg!r}")


def score_units(
    units: DataFrame,
    model: PrototypeModel,
    aggs: Sequence[str] = AGGREGATIONS,
    by: Sequence[str] = ("image_id",),
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """(by, key, scores, residual): both read-outs under every aggregation.

    Every unit is scored once and one aggregation gives all read-outs. Only images above
    `hot_rows` units, found from the id column alone, take the distributed quantile; their
    list cannot be longer than (all units / hot_rows), so it may be broadcast.
    """
    score = lambda rows: score_tiles(rows, model, ("sims", "weights", "residual"), keep=by)
    return _pooled_units(units, score, model.k, aggs, list(by), list(by), hot_rows)


def score_units_by(
    units: DataFrame,
    models: dict[int, PrototypeModel],
    aggs: Sequence[str] = AGGREGATIONS,
    by: Sequence[str] = ("image_id",),
    name: str = "fold",
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """`score_units` for several models of one width: (name, by, key, scores, residual), in one pass over the units."""
    score = lambda rows: score_models(rows, models, ("sims", "weights", "residual"), by, name)
    return _pooled_units(units, score, next(iter(models.values())).k, aggs, list(by), [name, *by], hot_rows)


def _pooled_units(units: DataFrame, score, k: int, aggs: Sequence[str], unit_by: list[str], by: list[str], hot_rows: int) -> DataFrame:
    """Read-outs of `score(units)` pooled by `by`; `unit_by` names an image among the units."""
    reads = (("cosine", "sims"), ("sparsemax", "weights"))
    fns = {"mean": F.avg, "max": F.max}
    quantiles = [a for a in aggs if a not in fns]
    for a in quantiles:
        if not a.startswith("q"):
            raise ValueError(f"unknown aggregation {a!r}")
        fns[a] = lambda c, q=int(a[1:]) / 100.0: F.percentile(c, q)
    index = range(k)

    def pooled(scored: DataFrame, names: Sequence[str]) -> DataFrame:
        cols = [fns[a](F.col(c)[i]).alias(f"_{r}_{a}_{i}") for r, c in reads for a in names for i in index]
        return scored.groupBy(*by).agg(F.avg("residual").alias("residual"), *cols)

    def unpacked(wide: DataFrame, names: Sequence[str]) -> DataFrame:
        array = lambda r, a: F.array(*[F.col(f"_{r}_{a}_{i}") for i in index])
        entries = [F.struct(F.lit(f"{r}/{a}").alias("key"), array(r, a).alias("scores")) for r, _ in reads for a in names]
        rows = wide.select(*by, "residual", F.explode(F.array(*entries)).alias("e"))
        return rows.select(*by, "e.key", "e.scores", "residual")

    if not quantiles:
        return unpacked(pooled(score(units), aggs), aggs)
    hot = units.groupBy(*unit_by).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).select(*unit_by)
    hot = F.broadcast(hot)
    usual = unpacked(pooled(score(units.join(hot, unit_by, "left_anti")), aggs), aggs)
    large = score(units.join(hot, unit_by, "left_semi"))
    plain = [a for a in aggs if a not in quantiles]
    wide = pooled(large, plain)
    parts = [unpacked(wide, plain)] if plain else []
    for a in quantiles:
        for r, c in reads:
            part = _long_quantile(large, int(a[1:]) / 100.0, c, by).withColumn("key", F.lit(f"{r}/{a}"))
            parts.append(part.join(wide.select(*by, "residual"), by).select(*by, "key", "scores", "residual"))
    out = usual
    for p in parts:
        out = out.unionByName(p)
    return out


def _long_quantile(scored: DataFrame, q: float, column: str, by: Sequence[str]) -> DataFrame:
    """Element-wise quantile by distributed order statistics, for images of any size."""
    from tessella.operators.ordering import exact_quantiles

    long = scored.select(*by, F.posexplode(column).alias("k", "score"))
    large = exact_quantiles(long, [*by, "k"], "score", [q])
    entries = F.array_sort(F.collect_list(F.struct("k", "score")))
    return large.groupBy(*by).agg(F.transform(entries, lambda e: e["score"]).alias("scores"))


def to_long(scores: DataFrame, classes: Sequence[str], arrays: Sequence[str] = ("scores", "label")) -> DataFrame:
    """One row per class: `scores` -> score, other arrays keep their name."""
    rest = [c for c in scores.columns if c not in arrays]
    zipped = F.posexplode(F.arrays_zip(*arrays)).alias("k", "_e")
    names = F.array(*[F.lit(c) for c in classes])
    return scores.select(*rest, zipped).select(
        *rest,
        "k",
        names[F.col("k")].alias("class"),
        *[F.col(f"_e.{a}").alias("score" if a == "scores" else a) for a in arrays],
    )


def to_wide(long: DataFrame, by: Sequence[str], value: str = "score", name: str = "scores") -> DataFrame:
    """The inverse of `to_long` for one value column."""
    entries = F.array_sort(F.collect_list(F.struct("k", value)))
    return long.groupBy(*by).agg(F.transform(entries, lambda e: e[value]).alias(name))


def sparsity(scored: DataFrame, column: str = "weights", eps: float = 1e-8) -> DataFrame:
    """Share of weights that are zero up to `eps`."""
    zeros = F.size(F.filter(column, lambda w: F.abs(w) <= eps))
    return scored.agg((F.sum(zeros) / F.sum(F.size(column))).alias("sparsity"))


def score_models(
    tiles: DataFrame,
    models: dict[int, PrototypeModel],
    outputs: Sequence[str] = ("sims",),
    keep: Sequence[str] = ("image_id", "tile_idx"),
    name: str = "fold",
    vec: str = "z",
) -> DataFrame:
    """`score_tiles` for several models in one pass over the tiles: (name, keep, outputs).

    Folds and seeds differ only in their parameters, so the vectors are read once and
    one scored row per model comes out, ready for partial aggregation.
    """
    first = next(iter(models.values()))
    single = score_tiles(tiles, first, outputs, keep, vec)
    schema = T.StructType([T.StructField(name, T.IntegerType()), *single.schema.fields])
    params = {
        int(f): (unit_rows(np.asarray(m.matrix, dtype=np.float64)), m.tau) for f, m in models.items()
    }
    wanted = list(outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            z = unit_rows(to_matrix(b.column(vec)))
            kept = [b.column(c) for c in keep]
            for f, (p, tau) in params.items():
                made = readouts(z, p, tau, wanted)
                cols = [pa.array(np.full(b.num_rows, f, dtype=np.int32)), *kept]
                cols += [to_lists(made[o]) if made[o].ndim == 2 else pa.array(made[o]) for o in wanted]
                yield pa.RecordBatch.from_arrays(cols, names=[name, *keep, *wanted])

    columns = list(dict.fromkeys([*keep, vec]))
    return tiles.select(*columns).mapInArrow(run, schema)
