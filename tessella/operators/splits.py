"""Splits, samples and protocols.

Random choices are by the order of `md5(id:seed)`: the sizes and constraints of a
shuffle, reproducible on any number of tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.functions.labels import combo_order, label_key, label_vector, parse_tokens
from tessella.operators.ordering import hash_rank, position

# Combinations held out per order, and the nested development draw.
HELDOUT_COUNTS = {1: 1, 2: 2, 3: 3, 4: 2, 6: 1}
DEV_COUNTS = {2: 1, 3: 2, 4: 1}
HELDOUT_ATTEMPTS = 50
DEV_ATTEMPTS = 100
DEV_SEED_FACTOR = 7919

# Fixed value: name of an augmented frame, frame number then copy number.
AUGMENTED_NAME = r"(?i)^frame_(\d+)_aug_(\d+)\.(jpg|jpeg|png)$"


def id_digest(column: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col(column).cast("string"), F.lit(str(seed))))


# ---- image level -----------------------------------------------------------------


def acquisition_position(images: DataFrame, path: str = "path", combo: str = "combo") -> DataFrame:
    """Add `pos` (0-based, by path) and `n` (images of the combination)."""
    size = images.groupBy(combo).agg(F.count("*").alias("n"))
    return position(images, [combo], path).join(F.broadcast(size), combo)


def temporal_split(
    images: DataFrame, train: float = 0.8, val: float = 0.1, path: str = "path", combo: str = "combo"
) -> DataFrame:
    """First round(train * n) images of a combination train, next round(val * n) validate,
    the rest test. Rounding is half to even; both counts are clamped."""
    n = F.col("n").cast("double")
    n_train = F.least(F.bround(n * train), n)
    n_val = F.least(F.bround(n * val), n - n_train)
    split = (
        F.when(F.col("pos") < n_train, "train").when(F.col("pos") < n_train + n_val, "val").otherwise("test")
    )
    return acquisition_position(images, path, combo).withColumn("split", split).select(*images.columns, "split")


def random_split(
    images: DataFrame, seed: int, val: float = 0.1, test: float = 0.1, key: str = "image_id"
) -> DataFrame:
    """Image-level split: test first, then validation, the rest trains; sizes truncate."""
    total = images.agg(F.count("*").alias("_n"))
    ranked = hash_rank(images.withColumn("_h", id_digest(key, seed)), [], "_h", [key])
    n_test, n_val = F.floor(F.col("_n") * test), F.floor(F.col("_n") * val)
    split = (
        F.when(F.col("pos") < n_test, "test").when(F.col("pos") < n_test + n_val, "val").otherwise("train")
    )
    return ranked.crossJoin(F.broadcast(total)).withColumn("split", split).select(*images.columns, "split")


def holdout_90_10(images: DataFrame, seed: int, frac: float = 0.1, key: str = "image_id") -> DataFrame:
    """train / val with floor(frac * n) validation images, drawn with seed + 1."""
    total = images.agg(F.count("*").alias("_n"))
    ranked = hash_rank(images.withColumn("_h", id_digest(key, seed + 1)), [], "_h", [key])
    split = F.when(F.col("pos") < F.floor(F.col("_n") * frac), "val").otherwise("train")
    return ranked.crossJoin(F.broadcast(total)).withColumn("split", split).select(*images.columns, "split")


def head_cap(images: DataFrame, n: int, order: str = "path") -> DataFrame:
    """First n rows in manifest order (a distributed top-n)."""
    return images.orderBy(order).limit(n)


def cap_per_combo(images: DataFrame, n: int, order: str = "path", combo: str = "combo") -> DataFrame:
    """First n rows per combination; the rank limit prunes map-side before the shuffle."""
    w = W.partitionBy(combo).orderBy(order)
    return images.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def stratified(images: DataFrame, n: int, seed: int, key: str = "image_id", combo: str = "combo") -> DataFrame:
    """max(1, n // number of combinations) images of every combination."""
    combos = images.agg(F.countDistinct(combo).alias("_c"))
    quota = F.greatest(F.lit(1), F.floor(F.lit(n) / F.greatest(F.col("_c"), F.lit(1))))
    w = W.partitionBy(combo).orderBy("_h", key)
    # every quota is at most n, so the constant bound lets the rank limit prune early
    ranked = images.withColumn("_h", id_digest(key, seed)).withColumn("_r", F.row_number().over(w))
    ranked = ranked.where(F.col("_r") <= max(1, n)).crossJoin(F.broadcast(combos))
    return ranked.where(F.col("_r") <= quota).select(*images.columns)


def subsample_tiles(tiles: DataFrame, t: int, seed: int) -> DataFrame:
    """Up to t tiles of every image, without replacement."""
    h = F.md5(F.concat_ws(":", F.col("image_id").cast("string"), F.col("tile_idx").cast("string"), F.lit(str(seed))))
    w = W.partitionBy("image_id").orderBy("_h", "tile_idx")
    ranked = tiles.withColumn("_h", h).withColumn("_r", F.row_number().over(w))
    return ranked.where(F.col("_r") <= t).drop("_r", "_h")


def cap_units(units: DataFrame, n: int, seed: int, key: Sequence[str] = ("image_id", "tile_idx")) -> DataFrame:
    """Uniform sample of at most n units.

    The n-th smallest digest is found from digest-cell counts, so the sample is a filter,
    not a sort of the vectors.
    """
    h = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    ranked = hash_rank(units.select(*key, h.alias("_h")), [], "_h", list(key))
    return units.join(ranked.where(F.col("pos") < n).select(*key), list(key), "left_semi")


def fixed_positions(spark, n_units: int, per_image: int | None, seed: int) -> DataFrame:
    """Unit positions every image keeps: `per_image` of range(n_units) by hash order."""
    positions = spark.range(n_units).select(F.col("id").cast("int").alias("unit_pos"))
    if per_image is None or n_units <= per_image:
        return positions
    return positions.orderBy(F.md5(F.concat_ws(":", F.col("unit_pos").cast("string"), F.lit(str(seed))))).limit(per_image)


def even_indices(total: Column, n: int) -> Column:
    """Distinct floor(i * total / n) for i < n; every index when n >= total."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * total / n).cast("bigint"))
    every = F.sequence(F.lit(0).cast("bigint"), total.cast("bigint") - 1)
    return F.when(total <= n, every).otherwise(F.array_distinct(spread))


def even_sample(frames: DataFrame, n: int, group: str, order: str) -> DataFrame:
    """Evenly spaced frames of every sequence, renumbered from 0 in `new_idx`."""
    size = frames.groupBy(group).agg(F.count("*").alias("_n"))
    wanted = size.select(group, F.posexplode(even_indices(F.col("_n"), n)).alias("new_idx", "pos"))
    return position(frames, [group], order).join(wanted, [group, "pos"]).drop("pos")


# ---- leave-combinations-out ------------------------------------------------------


def _combo_list(images: DataFrame) -> DataFrame:
    return images.select("combo").distinct().select(
        "combo", combo_order("combo").alias("order"), label_key("combo").alias("label_key")
    )


def _draw(combos: DataFrame, counts: dict[int, int], attempts: int, seed_of) -> DataFrame:
    """(attempt, combo, heldout): every attempt at once; combinations are few."""
    quota = F.create_map(*[F.lit(v) for kv in counts.items() for v in kv])
    tried = combos.select("*", F.explode(F.sequence(F.lit(0), F.lit(attempts))).alias("attempt"))
    w = W.partitionBy("attempt", "order").orderBy("_h", "combo")
    h = F.md5(F.concat_ws(":", "combo", seed_of(F.col("attempt")).cast("string")))
    ranked = tried.withColumn("_h", h).withColumn("_r", F.row_number().over(w))
    return ranked.withColumn("heldout", F.coalesce(F.col("_r") <= quota[F.col("order")], F.lit(False))).drop("_h", "_r")


def select_heldout(
    images: DataFrame, counts: dict[int, int] = HELDOUT_COUNTS, seed: int = 1337, attempts: int = HELDOUT_ATTEMPTS
) -> DataFrame:
    """(combo, role) with role heldout | trained | dropped.

    A combination whose label set equals a held-out one is dropped from training. The
    first attempt whose trained combinations still cover every class is used.
    """
    drawn = _draw(_combo_list(images), counts, attempts, lambda a: a + seed)
    same_set = W.partitionBy("attempt", "label_key")
    drawn = drawn.withColumn("_leaks", F.max(F.col("heldout").cast("int")).over(same_set) == 1)
    role = F.when(F.col("heldout"), "heldout").when(F.col("_leaks"), "dropped").otherwise("trained")
    drawn = drawn.withColumn("role", role)
    return _first_covering(drawn, F.col("role") == "trained")


def _first_covering(drawn: DataFrame, kept: Column) -> DataFrame:
    tokens = drawn.withColumn("_kept", kept).select(
        "attempt", "_kept", F.explode(parse_tokens("combo")).alias("token")
    )
    cover = tokens.groupBy("attempt", "token").agg(F.max(F.col("_kept").cast("int")).alias("_in"))
    good = cover.groupBy("attempt").agg(F.min("_in").alias("_all")).where("_all = 1")
    first = good.agg(F.min("attempt").alias("attempt")).select(
        F.coalesce("attempt", F.raise_error(F.lit("no draw keeps every class covered")).cast("int")).alias("attempt")
    )
    return drawn.join(F.broadcast(first), "attempt").select("combo", "order", "role")


def select_dev_combos(
    combos: DataFrame, counts: dict[int, int] = DEV_COUNTS, seed: int = 1337, attempts: int = DEV_ATTEMPTS
) -> DataFrame:
    """Nested development combinations out of the trained ones: (combo, order, role)."""
    drawn = _draw(_combo_list(combos), counts, attempts, lambda a: a + seed * DEV_SEED_FACTOR)
    drawn = drawn.withColumn("role", F.when(F.col("heldout"), "dev").otherwise("train"))
    return _first_covering(drawn, F.col("role") == "train")


def order_combos(df: DataFrame) -> DataFrame:
    return df.orderBy(combo_order("combo"), "combo")


def drop_label_sets(images: DataFrame, heldout: DataFrame) -> DataFrame:
    """Remove every combination whose label set equals a held-out one."""
    keys = heldout.select(label_key("combo").alias("_key")).distinct()
    return images.withColumn("_key", label_key("combo")).join(F.broadcast(keys), "_key", "left_anti").drop("_key")


def lco_split(images: DataFrame, roles: DataFrame, seed: int = 1337) -> DataFrame:
    """Images with split train | val | test; dropped combinations leave."""
    tagged = images.join(F.broadcast(roles.select("combo", "role")), "combo")
    trained = holdout_90_10(tagged.where("role = 'trained'"), seed)
    test = tagged.where("role = 'heldout'").withColumn("split", F.lit("test"))
    return trained.unionByName(test).drop("role")


def build_protocol(split_images: DataFrame, dev_roles: DataFrame) -> DataFrame:
    """`role` in {train, val, dev, test} plus `in_train_full` for the undivided train split."""
    dev = dev_roles.where("role = 'dev'").select("combo", F.lit(True).alias("_dev"))
    tagged = split_images.join(F.broadcast(dev), "combo", "left")
    role = (
        F.when(F.col("split") == "test", "test")
        .when(F.coalesce("_dev", F.lit(False)), "dev")
        .otherwise(F.col("split"))
    )
    return tagged.withColumn("role", role).withColumn("in_train_full", F.col("split") == "train").drop("_dev")


def dev_union(train: DataFrame, val: DataFrame) -> DataFrame:
    return train.unionByName(val)


def uncovered_classes(trained: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Classes no trained combination contains."""
    have = trained.select(F.explode(parse_tokens("combo")).alias("class")).distinct()
    spark = trained.sparkSession
    return spark.createDataFrame([(c,) for c in classes], "class string").join(have, "class", "left_anti")


def build_folds(
    combos: DataFrame, n_folds: int = 5, seed: int = 1337, hold_out_singletons: bool = False
) -> DataFrame:
    """(combo, order, fold): development fold of every combination of order >= 2.

    Dealing a shuffled list always to the smallest fold (lowest number on ties) is dealing
    round robin over (order, shuffle position). Singletons stay in training (no row)
    unless held out, one per fold.
    """
    listed = combos.select("combo").distinct().withColumn("order", combo_order("combo"))
    h = F.md5(F.concat_ws(":", "combo", F.lit(str(seed))))
    higher = listed.where(F.col("order") > 1).withColumn("_h", h)
    deal = W.partitionBy(F.lit(0)).orderBy("order", "_h", "combo")  # one row per combination
    folds = higher.withColumn("fold", F.pmod(F.row_number().over(deal) - 1, F.lit(n_folds)).cast("int")).drop("_h")
    if hold_out_singletons:
        single = listed.where(F.col("order") == 1).withColumn("_h", h)
        one = W.partitionBy(F.lit(0)).orderBy("_h", "combo")
        single = single.withColumn("fold", (F.row_number().over(one) - 1).cast("int")).drop("_h")
        checked = F.when(
            F.col("fold") >= n_folds, F.raise_error(F.lit("need exactly one singleton per fold")).cast("int")
        ).otherwise(F.col("fold"))
        folds = folds.unionByName(single.withColumn("fold", checked))
    return folds


def fold_coverage(combos: DataFrame, folds: DataFrame, n_folds: int) -> DataFrame:
    """(fold, class) pairs whose fold's training combinations miss the class (empty = good)."""
    every = combos.select("combo", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold"))
    train = every.join(folds.select("combo", "fold"), ["combo", "fold"], "left_anti")
    token = F.explode(parse_tokens("combo")).alias("class")
    return every.select("fold", token).distinct().join(train.select("fold", token).distinct(), ["fold", "class"], "left_anti")


def expand_folds(rows: DataFrame, folds: DataFrame, n_folds: int) -> DataFrame:
    """Every row once per fold with role train | dev."""
    mine = folds.select("combo", F.col("fold").alias("_dev_fold"))
    tagged = rows.join(F.broadcast(mine), "combo", "left")
    out = tagged.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    role = F.when(F.col("fold") == F.col("_dev_fold"), "dev").otherwise("train")
    return out.withColumn("role", role).drop("_dev_fold")


# ---- leave-one-class-out ---------------------------------------------------------


def expand_loso(rows: DataFrame, n_classes: int, inner: bool = False) -> DataFrame:
    """Every row once per held-out class `k_star`, optionally per inner class `k_in` too."""
    every = F.sequence(F.lit(0), F.lit(n_classes - 1))
    out = rows.withColumn("k_star", F.explode(every))
    if not inner:
        return out
    return out.withColumn("k_in", F.explode(F.filter(every, lambda k: k != F.col("k_star"))))


def loso_folds(images: DataFrame, classes: Sequence[str]) -> DataFrame:
    """(k_star, image, kept, unknown): training keeps images without the held-out class,
    test images with it are unknown."""
    label = label_vector(parse_tokens("combo"), classes)
    out = expand_loso(images.withColumn("label", label), len(classes))
    has = F.element_at("label", F.col("k_star") + 1) == 1
    return out.withColumn("kept", ~has).withColumn("unknown", has.cast("int"))


#: Hexadecimal digits of the hash that deal rows into the ranges of `mixup_pairs`.
MIX_DIGITS = 2


def mixup_pairs(tiles: DataFrame, seed: int, alpha: float = 0.2, vec: str = "z", label: str = "label") -> DataFrame:
    """`tiles` with `lam`, and `_z`, `_y`: vector and label of the row each is mixed with.

    Positions in hash order are a permutation; row i is paired with row i + 1, the last with the first. Rows are
    dealt once, by the first digits of their hash, and sorted within these ranges; only the first row of each
    range, 16^MIX_DIGITS rows at most, is sent to the tasks. The weight is Beta(alpha, alpha), exactly and from two
    uniforms: with p = u^(1/alpha) and c = cos(2 pi v) it is (1 + c / sqrt(p / (1 - p) + c^2)) / 2.
    """
    h = F.md5(F.concat_ws(":", F.col("image_id").cast("string"), F.col("tile_idx").cast("string"), F.lit(str(seed))))
    keyed = tiles.withColumn("_h", h).withColumn("_range", F.substring("_h", 1, MIX_DIGITS))
    mine = F.struct(F.col(vec).alias("z"), F.col(label).alias("y"))
    first = keyed.groupBy("_range").agg(F.min_by(mine, F.struct("_h", "image_id", "tile_idx")).alias("_first"))
    ranges = W.partitionBy(F.lit(0)).orderBy("_range")
    around = F.first("_first").over(ranges.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    ahead = first.select("_range", F.coalesce(F.lead("_first").over(ranges), around).alias("_ahead"))
    within = W.partitionBy("_range").orderBy("_h", "image_id", "tile_idx")
    rows = keyed.withColumn("_next", F.lead(mine).over(within)).join(F.broadcast(ahead), "_range")
    uniform = lambda tag: (F.conv(F.substring(F.md5(F.concat(F.col("_h"), F.lit(tag))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    p, c = F.pow(uniform("u"), F.lit(1.0 / alpha)), F.cos(uniform("v") * (2 * math.pi))
    lam = (1 + c / F.sqrt(p / F.greatest(1 - p, F.lit(2.0**-53)) + c * c)) / 2
    other = F.coalesce("_next", "_ahead")
    return rows.select(*tiles.columns, lam.alias("lam"), other["z"].alias("_z"), other["y"].alias("_y"))


def mixup(tiles: DataFrame, seed: int, alpha: float = 0.2, vec: str = "z", label: str = "label") -> DataFrame:
    """Each tile mixed with a random other one (`mixup_pairs`): convex vectors, maximum of the labels."""
    mixed = F.zip_with(vec, "_z", lambda x, y: x * F.col("lam") + y * (F.lit(1.0) - F.col("lam")))
    return mixup_pairs(tiles, seed, alpha, vec, label).select(
        "image_id", "tile_idx", "lam", mixed.alias(vec), F.zip_with(label, "_y", lambda a, b: F.greatest(a, b)).alias(label)
    )


# ---- summaries and plans ---------------------------------------------------------


def split_summary(images: DataFrame) -> DataFrame:
    """Counts per (split, combo), per split and in total, with the share of the total."""
    counts = images.rollup("split", "combo").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    total = counts.where("level = 3").select(F.col("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(
        "split", "combo", "n", (F.col("n") / F.col("_total")).alias("share")
    )


def rename_plan(files: DataFrame, folder: str = "folder", name: str = "name") -> DataFrame:
    """(folder, name, new_name): renumber augmented frames by (frame, copy) from 00001.jpg."""
    pattern = AUGMENTED_NAME
    parsed = files.where(F.col(name).rlike(pattern)).select(
        folder,
        name,
        F.regexp_extract(name, pattern, 1).cast("bigint").alias("_frame"),
        F.regexp_extract(name, pattern, 2).cast("bigint").alias("_aug"),
    )
    ranked = position(parsed, [folder], "_frame", ties=["_aug", name])
    return ranked.select(folder, name, F.format_string("%05d.jpg", F.col("pos") + 1).alias("new_name"))
