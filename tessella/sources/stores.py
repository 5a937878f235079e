"""Keyed Parquet stores: features, units, scores, results, models, predictions."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.model import PrototypeModel
from tessella.operators.scoring import to_long
from tessella.operators.splits import fixed_positions


def config_hash(config: dict) -> str:
    """Key of everything that changes features: encoder, tiling, mode, illumination."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def _read(spark, root: str, **equals) -> DataFrame | None:
    try:
        df = spark.read.parquet(root)
    except AnalysisException:
        return None
    for column, value in equals.items():
        df = df.where(F.col(column) == value)
    return df


def _fills(spark, root: str, key: str) -> DataFrame | None:
    """Committed rows of a configuration with `fill` and `at`, the commit's time; rows without a commit record are not seen."""
    commits = _read(spark, f"{root}/commits", config_hash=key)
    if commits is None:
        return None
    done = commits.groupBy("fill").agg(F.min("at").alias("at"))  # one row a fill
    return spark.read.parquet(f"{root}/data").where(F.col("config_hash") == key).join(F.broadcast(done), "fill")


def stored_features(spark, root: str, config: dict) -> DataFrame | None:
    """Rows stored under `config`, or None; a path that two writers filled counts once, as the first to commit wrote it."""
    rows = _fills(spark, root, config_hash(config))
    if rows is None:
        return None
    by = rows.select("path", "at", "fill").distinct()
    twice = by.groupBy("path").agg(F.min(F.struct("at", "fill")).alias("own"), F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        rows = rows.join(twice.select("path", F.col("own.fill").alias("_own")), "path", "left").where("_own IS NULL OR _own = fill").drop("_own")
    return rows.drop("fill", "at")


def feature_store(
    images: DataFrame, extract: Callable[[DataFrame], DataFrame], root: str, config: dict
) -> DataFrame:
    """Tile vectors of `images` (image_id, path) under `config`, extracting only what is new.

    `extract(images)` returns rows keyed by image_id. The table is partitioned by the hash of
    the configuration and by fill, so another configuration neither hits nor overwrites this one,
    and a changed list re-extracts its new paths only. A fill counts once its commit record is
    written: a job that dies half-way leaves rows that nobody reads, and of two writers that
    fill the same paths at once the first to commit is read.
    """
    spark, key, fill = images.sparkSession, config_hash(config), uuid.uuid4().hex
    have = stored_features(spark, root, config)
    todo = images if have is None else images.join(have.select("path").distinct(), "path", "left_anti")
    made = extract(todo).join(todo.select("image_id", "path"), "image_id").withColumns({"config_hash": F.lit(key), "fill": F.lit(fill)})
    made.write.mode("append").partitionBy("config_hash", "fill").parquet(f"{root}/data")
    commit_fill(spark, root, config, fill)
    return stored_features(spark, root, config).join(images.select("path"), "path", "left_semi").drop("config_hash")


def commit_fill(spark, root: str, config: dict, fill: str) -> None:
    """Make the rows of a fill count; committing it again changes nothing."""
    record = [(config_hash(config), fill, time.time(), json.dumps(config, sort_keys=True))]
    spark.createDataFrame(record, "config_hash string, fill string, at double, config string").coalesce(1).write.mode("append").parquet(f"{root}/commits")


def assert_feature_key(stored: DataFrame, images: DataFrame, config: dict) -> DataFrame:
    """`stored` if it holds exactly the paths of `images` under `config`; else an error on use."""
    key = config_hash(config)
    other = stored.where(F.col("config_hash") != key).limit(1).count()
    if other:
        raise ValueError("the stored features were made under another configuration")
    a, b = stored.select("path").distinct(), images.select("path").distinct()
    diff = a.join(b, "path", "left_anti").withColumn("side", F.lit("stored only")).unionByName(
        b.join(a, "path", "left_anti").withColumn("side", F.lit("wanted only"))
    )
    bad = diff.limit(1).collect()
    if bad:
        raise ValueError(f"the stored features cover other images, for example {bad[0]['path']} ({bad[0]['side']})")
    return stored


def unit_store(units: DataFrame, root: str, n_units: int, per_image: int | None, seed: int) -> DataFrame:
    """Write (granularity, split, image_id, unit_pos, z), keeping the same unit positions of
    every image."""
    keep = fixed_positions(units.sparkSession, n_units, per_image, seed)
    chosen = units.join(F.broadcast(keep), "unit_pos", "left_semi")
    chosen.write.mode("overwrite").partitionBy("granularity", "split").parquet(root)
    return units.sparkSession.read.parquet(root)


def missing_scores(scores: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, key) pairs that have no score."""
    keys = scores.select("key").distinct()
    want = images.select("image_id").crossJoin(F.broadcast(keys))
    return want.join(scores.select("image_id", "key"), ["image_id", "key"], "left_anti")


def score_store(scores: DataFrame, images: DataFrame, root: str) -> DataFrame:
    """Write (image_id, key, scores, ...), then require every image under every key."""
    scores.write.mode("overwrite").partitionBy("key").parquet(root)
    stored = images.sparkSession.read.parquet(root)
    gap = missing_scores(stored, images)
    n = gap.count()
    if n:
        raise ValueError(f"{n} scores are missing, for example of image {gap.first()['image_id']}")
    return stored


def append_results(rows: DataFrame, root: str, key: Sequence[str]) -> int:
    """Append runs whose key is not stored yet; returns how many rows were added."""
    have = _read(rows.sparkSession, root)
    new = rows if have is None else rows.join(have.select(*key).distinct(), list(key), "left_anti")
    n = new.count()
    if n:
        new.write.mode("append").parquet(root)
    return n


def save_model(spark, model: PrototypeModel, root: str, run_id: str, method: str) -> None:
    """Rows of one fitted model: class by class, with thresholds and configuration."""
    limits = model.thresholds or (None,) * model.k
    taus = np.broadcast_to(np.asarray(model.tau, dtype=float), (model.k,))
    params = {k: json.dumps(v) for k, v in model.config.items()}
    rows = [
        (run_id, method, k, c, model.source[k] if model.source else None, [float(x) for x in model.matrix[k]],
         None if k >= len(limits) or limits[k] is None else float(limits[k]), model.unknown_threshold, float(taus[k]), params)
        for k, c in enumerate(model.classes)
    ]
    schema = ("run_id string, method string, k int, class string, source string, p array<double>, threshold double, "
              "unknown_threshold double, tau double, params map<string,string>")
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").partitionBy("run_id").parquet(root)


def load_model(spark, root: str, run_id: str, classes: Sequence[str] | None = None) -> PrototypeModel:
    """The model of a run; with `classes`, rows are matched by name and re-ordered."""
    rows = sorted(spark.read.parquet(root).where(F.col("run_id") == run_id).collect(), key=lambda r: r["k"])
    if not rows:
        raise KeyError(run_id)
    if classes is not None:
        by_name = {r["class"]: r for r in rows}
        gone = [c for c in classes if c not in by_name]
        if gone:
            raise ValueError(f"the model has no prototype for {gone}")
        rows = [by_name[c] for c in classes]
    taus = np.array([r["tau"] for r in rows])
    limits = tuple(r["threshold"] for r in rows)
    return PrototypeModel(
        tuple(r["class"] for r in rows),
        np.array([r["p"] for r in rows]),
        tuple(r["source"] or "" for r in rows),
        float(taus[0]) if (taus == taus[0]).all() else taus,
        limits if any(t is not None for t in limits) else None,
        rows[0]["unknown_threshold"],
        {k: json.loads(v) for k, v in (rows[0]["params"] or {}).items()},
    )


def wide_predictions(preds: DataFrame, classes: Sequence[str], extras: Sequence[str] = (), prefix: str = "score") -> DataFrame:
    """(image, extras, <prefix>_<class>, present_<class>): plain columns from the arrays.

    The class list fixes the columns, so no pivot (and no shuffle) is needed.
    """
    cols = [F.col("scores")[i].alias(f"{prefix}_{c}") for i, c in enumerate(classes)]
    cols += [(F.col("pred")[i] == 1).alias(f"present_{c}") for i, c in enumerate(classes)]
    return preds.select("image", *extras, *cols)


def write_predictions(preds: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = preds.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def long_predictions(preds: DataFrame, classes: Sequence[str]) -> DataFrame:
    """(image, k, class, score, pred)."""
    return to_long(preds.select("image", "scores", "pred"), classes, ("scores", "pred"))
