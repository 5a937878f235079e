"""Class prototypes from labelled tiles.

Mean vectors are formed in two steps: every task sums its own rows into one vector per
class, then K x (number of tasks) partial vectors are added up. Fitting is an action; it
returns K x D numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.kernels import to_lists, to_matrix, unit_rows
from tessella.functions.labels import parse_tokens
from tessella.model import PrototypeModel


def image_sums(tiles: DataFrame, vec: str = "z", unit: bool = True) -> DataFrame:
    """(image_id, s, n): vector sums of the tiles of an image that share an Arrow batch.

    Tiles of an image usually lie together, so joining labels to these sums moves about
    one vector per image instead of one per tile.
    """
    schema = "image_id bigint, s array<double>, n double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, at = np.unique(b.column("image_id").to_numpy(zero_copy_only=False), return_inverse=True)
            z = to_matrix(b.column(vec))
            order = np.argsort(at, kind="stable")
            starts = np.searchsorted(at[order], np.arange(len(ids)))
            sums = np.add.reduceat((unit_rows(z) if unit else z)[order], starts, axis=0)
            counts = np.bincount(at, minlength=len(ids)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), to_lists(sums), pa.array(counts)], names=["image_id", "s", "n"])

    return tiles.select("image_id", vec).mapInArrow(run, schema)


def partial_sums(
    df: DataFrame, keys: Sequence[str], vec: str = "z", weight: str | None = None, unit: bool = True, count: str | None = None
) -> DataFrame:
    """(keys, s, n): per-task vector sums and counts (weight totals, or sums of `count`).

    `keys` must take few distinct values, since a task holds one vector for each.
    """
    keys = list(keys)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in (df.schema[k] for k in keys))
    schema = (schema + ", " if schema else "") + "s array<double>, n double"
    cols = [*keys, vec, *[c for c in (weight, count) if c]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        counts: dict[tuple, float] = {}
        types = None
        for b in batches:
            if not b.num_rows:
                continue
            types = [b.schema.field(k).type for k in keys]
            z = to_matrix(b.column(vec))
            z = unit_rows(z) if unit else z
            w = b.column(weight).to_numpy(zero_copy_only=False) if weight else np.ones(len(z))
            labels = list(zip(*[b.column(k).to_pylist() for k in keys])) if keys else [()] * len(z)
            index = {g: i for i, g in enumerate(dict.fromkeys(labels))}
            at = np.array([index[g] for g in labels])
            onehot = np.zeros((len(index), len(z)))
            onehot[at, np.arange(len(z))] = w
            part = onehot @ z
            size = b.column(count).to_numpy(zero_copy_only=False) if count else np.ones(len(z))
            for g, i in index.items():
                sums[g] = sums.get(g, 0.0) + part[i]
                counts[g] = counts.get(g, 0.0) + float(onehot[i] @ size)
        if sums:
            groups = list(sums)
            arrays = [pa.array([g[j] for g in groups], type=types[j]) for j in range(len(keys))]
            arrays += [to_lists(np.stack([sums[g] for g in groups])), pa.array([float(counts[g]) for g in groups])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "s", "n"])

    return df.select(*cols).mapInArrow(run, schema)


def total_vectors(partials: DataFrame, keys: Sequence[str], vec: str = "s") -> DataFrame:
    """(keys, s): element-wise total of the vectors per key, added up as whole vectors with partial aggregation.

    A row for each key leaves a task, whatever the vectors' length.
    """
    return _unpacked(partials.groupBy(*keys).agg(_vector_total(vec)))


def _vector_total(vec: str) -> Column:
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    return Summarizer.sum(array_to_vector(vec)).alias("s")


def _unpacked(total: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return total.withColumn("s", vector_to_array("s"))


def add_vectors(partials: DataFrame, keys: Sequence[str], vec: str = "s") -> DataFrame:
    """Element-wise total of the partial vectors per key: (keys, s, n)."""
    keys = list(keys)
    # the summarizer adds running means, which leave a count a little under its whole number: counts are added by themselves
    whole = partials.groupBy(*keys).agg(_vector_total("s"), F.sum("n").alias("n"))
    return _unpacked(whole).select(*keys, "s", "n").where(F.col("s").isNotNull())


def mean_vector(df: DataFrame, keys: Sequence[str], vec: str = "z", unit: bool = True) -> DataFrame:
    """(keys, mean, n): element-wise mean per key, for few keys."""
    total = add_vectors(partial_sums(df, keys, vec, unit=unit), keys)
    return total.select(*keys, F.transform("s", lambda v: v / F.col("n")).alias("mean"), "n")


def labelled_tiles(tiles: DataFrame, images: DataFrame) -> DataFrame:
    """Tiles with the combination of their image; both sides are keyed by `image_id`."""
    return tiles.join(images.select("image_id", "combo"), "image_id")


def prototype_sums(tiles: DataFrame, images: DataFrame, classes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, k, source, s, n) in one scan of the tiles.

    Tiles are first summed per combination (the label is constant there), then each
    combination's vector counts as `any` for its classes and as `pure` when the
    combination is the class itself. `by` may hold further columns of `images`.
    """
    by = list(by)
    return combo_to_class_sums(combo_sums(tiles, images, by), classes, by)


def combo_sums(tiles: DataFrame, images: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(combo, by, s, n): total of the unit tile vectors of every combination."""
    keys = ["combo", *by]
    joined = image_sums(tiles).join(images.select("image_id", *keys), "image_id")
    return add_vectors(partial_sums(joined, keys, "s", unit=False, count="n"), keys)


def combo_to_class_sums(per_combo: DataFrame, classes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    names = F.array(*[F.lit(c) for c in classes])
    present = F.filter(
        F.transform(names, lambda c, i: F.struct(i.alias("k"), c.alias("class"))),
        lambda e: F.array_contains(parse_tokens("combo"), e["class"]),
    )
    rows = per_combo.select(*by, "combo", "s", "n", F.explode(present).alias("e"))
    sources = F.when(F.col("combo") == F.col("e.class"), F.array(F.lit("any"), F.lit("pure"))).otherwise(F.array(F.lit("any")))
    return add_vectors(rows.select(*by, F.col("e.k").alias("k"), F.explode(sources).alias("source"), "s", "n"), [*by, "k", "source"])


def choose_source(sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, k, source, p): the pure mean where there is one, else the mean over images
    containing the class; normalised."""
    by = list(by)
    picked = sums.groupBy(*by, "k").agg(F.max_by(F.struct("source", "s", "n"), F.col("source")).alias("e"))
    from tessella.functions.vectors import l2_normalize

    unit = l2_normalize(F.transform("e.s", lambda v: v / F.col("e.n")))
    return picked.select(*by, "k", F.col("e.source").alias("source"), unit.alias("p"))


def _to_model(rows, classes: Sequence[str], tau) -> PrototypeModel:
    rows = sorted(rows, key=lambda r: r["k"])
    missing = sorted(set(range(len(classes))) - {r["k"] for r in rows})
    if missing:
        raise ValueError(f"no tiles for class {[classes[k] for k in missing]}")
    return PrototypeModel(
        tuple(classes), np.array([r["p"] for r in rows]), tuple(r["source"] for r in rows), tau
    )


def hybrid_prototypes(tiles: DataFrame, images: DataFrame, classes: Sequence[str], tau=10.0) -> PrototypeModel:
    """Pure-culture mean per class, falling back to every image that contains the class."""
    return _to_model(choose_source(prototype_sums(tiles, images, classes)).collect(), classes, tau)


def pure_prototypes(
    tiles: DataFrame, images: DataFrame, classes: Sequence[str], tau=10.0
) -> PrototypeModel | None:
    """Pure-culture means, or None when any class lacks a pure culture."""
    pure = images.where(F.col("combo").isin(list(classes)))
    rows = choose_source(prototype_sums(tiles, pure, classes).where("source = 'pure'")).collect()
    return _to_model(rows, classes, tau) if len(rows) == len(classes) else None


def prototypes_by(
    tiles: DataFrame, images: DataFrame, classes: Sequence[str], by: Sequence[str], tau=10.0
) -> dict[tuple, PrototypeModel]:
    """One hybrid model per value of `by` (folds, seeds) from a single scan."""
    groups: dict[tuple, list] = {}
    for r in choose_source(prototype_sums(tiles, images, classes, by), by).collect():
        groups.setdefault(tuple(r[b] for b in by), []).append(r)
    return {g: _to_model(rows, classes, tau) for g, rows in sorted(groups.items())}


def kmeans_prototypes(tiles: DataFrame, k: int, seed: int = 1337, tau=10.0) -> PrototypeModel:
    """k-means|| on unit tiles; centres re-normalised. Column order carries no class."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from tessella.functions.vectors import l2_normalize

    data = tiles.select(array_to_vector(l2_normalize(F.col("z"))).alias("features"))
    fitted = KMeans(k=k, seed=seed).fit(data)
    centres = unit_rows(np.array(fitted.clusterCenters()))
    return PrototypeModel(tuple(f"cluster{i}" for i in range(k)), centres, ("kmeans",) * k, tau)


def random_prototypes(tiles: DataFrame, k: int, seed: int = 1337, tau=10.0) -> PrototypeModel:
    """K rows by hash order (a top-K, not a global shuffle)."""
    key = F.md5(F.concat_ws(":", "image_id", "tile_idx", F.lit(seed)))
    rows = tiles.select("z", key.alias("h")).orderBy("h").limit(k).collect()
    return PrototypeModel(
        tuple(f"row{i}" for i in range(k)), unit_rows(np.array([r["z"] for r in rows])), ("random",) * k, tau
    )


def init_prototypes(
    tiles: DataFrame, images: DataFrame, classes: Sequence[str], mode: str = "auto", seed: int = 1337, tau=10.0
) -> PrototypeModel:
    """auto | pure | kmeans | random; `auto` tries pure cultures, then k-means."""
    if mode in ("auto", "pure"):
        model = pure_prototypes(tiles, images, classes, tau)
        if model is not None:
            return model
        if mode == "pure":
            raise ValueError("a class has no pure culture")
    if mode == "random":
        return random_prototypes(tiles, len(classes), seed, tau)
    if mode in ("auto", "kmeans"):
        return kmeans_prototypes(tiles, len(classes), seed, tau)
    raise ValueError(f"unknown init mode {mode!r}")


def mean_pairwise_sim(model: PrototypeModel) -> float:
    """Mean off-diagonal cosine of the K prototypes."""
    gram = unit_rows(model.matrix) @ unit_rows(model.matrix).T
    return float(gram[~np.eye(model.k, dtype=bool)].mean())


def prototype_table(spark, model: PrototypeModel) -> DataFrame:
    rows = [
        (k, c, model.source[k] if model.source else None, [float(x) for x in model.matrix[k]])
        for k, c in enumerate(model.classes)
    ]
    return spark.createDataFrame(rows, "k int, class string, source string, p array<double>")


def pca_basis(tiles: DataFrame, d: int) -> np.ndarray:
    """Top-d principal directions (d, D) of all rows, up to sign; second moments are added up in a tree."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    data = tiles.select(array_to_vector(F.transform("z", lambda x: x.cast("double"))).alias("features"))
    return PCA(k=d, inputCol="features", outputCol="o").fit(data).pc.toArray().T
