"""Images as rows that hold the vectors of all their tiles, so that pooling needs no shuffle.

A row is a bag: one image, or a part of an image with more than BAG_TILES tiles. Bags are made
once; then attention pooling, its gradient and its scores are maps over bags. Only images in
parts meet again, by one vector for each part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.kernels import sigmoid, to_lists, to_matrix, unit_rows
from tessella.operators.prototypes import total_vectors

if TYPE_CHECKING:
    from tessella.operators.fit import AttentionModel

#: Tiles of a bag at most, about.
BAG_TILES = 4096


def make_bags(tiles: DataFrame, limit: int | None = None) -> DataFrame:
    """(image_id, part, parts, n, z): the tiles' vectors of an image in a row, one after the other.

    Images of more than `limit` tiles are dealt into parts by tile number; these are at most
    (all tiles / limit) images, found from the id column alone.
    """
    limit = limit or BAG_TILES
    long = tiles.groupBy("image_id").agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    long = long.select("image_id", F.ceil(F.col("_n") / limit).cast("int").alias("parts"))
    rows = tiles.join(long, "image_id", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("tile_idx"), F.col("parts")).cast("int")
    bags = rows.groupBy("image_id", part.alias("part"), "parts").agg(F.count("*").cast("int").alias("n"), F.flatten(F.collect_list("z")).alias("z"))
    return bags.select("image_id", "part", "parts", "n", "z")


def _tiles_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit rows of all tiles, first tile of each bag, bag of each tile)."""
    n = batch.column("n").to_numpy()
    flat = batch.column("z").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit_rows(flat.reshape(int(n.sum()), -1)), np.r_[0, np.cumsum(n)[:-1]], np.repeat(np.arange(len(n)), n)


def _pooled(z: np.ndarray, starts: np.ndarray, model: AttentionModel) -> tuple[np.ndarray, np.ndarray]:
    """(weighted sums, masses) of bags."""
    a = np.exp(model.energy(z) - model.shift())
    return np.add.reduceat(a[:, None] * z, starts, axis=0), np.add.reduceat(a, starts)


def pool_bags(bags: DataFrame, model: AttentionModel) -> DataFrame:
    """(image_id, bag, mass): attention-weighted means; only parts of long images are shuffled, one vector each."""
    schema = T.StructType([bags.schema["image_id"], *T._parse_datatype_string("bag array<double>, mass double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                z, starts, _ = _tiles_of(b)
                s, mass = _pooled(z, starts, model)
                whole = b.column("parts").to_numpy() == 1
                yield pa.RecordBatch.from_arrays([b.column("image_id"), to_lists(np.where(whole[:, None], s / mass[:, None], s)), pa.array(mass)], names=schema.names)

    cols = ["image_id", "parts", "n", "z"]
    one = bags.where("parts = 1").select(*cols).mapInArrow(run, schema)
    many = bags.where("parts > 1").select(*cols).mapInArrow(run, schema)
    total = total_vectors(many.select("image_id", F.concat("bag", F.array("mass")).alias("s")), ["image_id"])
    mass = F.element_at("s", -1)
    mean = F.transform(F.slice("s", F.lit(1), F.size("s") - 1), lambda v: v / mass)
    return one.unionByName(total.select("image_id", mean.alias("bag"), mass.alias("mass")))


def score_bags(bags: DataFrame, model: AttentionModel) -> DataFrame:
    """(image_id, scores): sigmoid of the linear head on the pooled vector."""
    from tessella.operators.scoring import _map_vectors

    fn = lambda b: {"scores": sigmoid(b @ model.weight.T + model.bias)}
    return _map_vectors(pool_bags(bags, model), "bag", ("image_id",), {"scores": T.ArrayType(T.DoubleType())}, fn)


def bag_gradients(model: AttentionModel, n_images: int) -> Callable[[pa.RecordBatch], np.ndarray]:
    """Loss and gradients (V, U, w, head, bias) summed over bags with `label`; rows of long images bring `bag` and `mass`."""
    from tessella.operators.fit import attention_tile_grad, bce_sums

    k = len(model.classes)

    def sums(batch: pa.RecordBatch) -> np.ndarray:
        z, starts, owner = _tiles_of(batch)
        y = to_matrix(batch.column("label"))
        if "bag" in batch.schema.names:
            bag, mass, once = to_matrix(batch.column("bag")), batch.column("mass").to_numpy(), batch.column("part").to_numpy() == batch.column("first").to_numpy()
        else:
            s, mass = _pooled(z, starts, model)
            bag, once = s / mass[:, None], np.ones(len(s), bool)
        loss, d = bce_sums(bag @ model.weight.T + model.bias, y)
        d_bag = d @ model.weight / (n_images * k)
        tile = attention_tile_grad(z, bag[owner], d_bag[owner], mass[owner], model)
        if not once.all():
            loss, _ = bce_sums(bag[once] @ model.weight.T + model.bias, y[once])
        head = [d[once].T @ bag[once], d[once].sum(axis=0)]
        return np.concatenate([[loss / (n_images * k)], *[g.ravel() for g in tile], *[g.ravel() / (n_images * k) for g in head]])

    return sums


def epoch_sums(bags: DataFrame, model: AttentionModel, n_images: int, long: bool) -> np.ndarray:
    """The totals of `bag_gradients`: a map over the bags of whole images, and with `long` one over parts joined to their pooled vectors."""
    from tessella.operators.clusters import batch_sums

    fn, cols = bag_gradients(model, n_images), ["n", "z", "label"]
    out = batch_sums(bags.where("parts = 1"), cols, fn)
    if long:
        parts = bags.where("parts > 1")
        first = parts.groupBy("image_id").agg(F.min("part").alias("first"))
        pooled = pool_bags(parts, model).join(first, "image_id")
        more = batch_sums(parts.join(pooled, "image_id"), [*cols, "bag", "mass", "part", "first"], fn)
        out = more if not len(out) else out + more
    return out


def split_sums(out: np.ndarray, hidden: int, dim: int, k: int) -> tuple[float, Sequence[np.ndarray]]:
    """(loss, gradients in the order of the parameters)."""
    sizes = np.cumsum([1, hidden * dim, hidden * dim, hidden, k * dim])
    v, u, w, head, bias = np.split(out, sizes)[1:]
    return float(out[0]), [v.reshape(hidden, dim), u.reshape(hidden, dim), w, head.reshape(k, dim), bias]
