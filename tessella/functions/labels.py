"""Column functions on combination names and label vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a folder token of this shape is a repeat session, not a class.
TAKE_TOKEN = r"(?i)^take\d+$"


def parse_tokens(combo) -> Column:
    """`a_b_take2` -> [a, b]: split on `_`, drop empty parts and take markers."""
    return F.filter(F.split(combo, "_"), lambda t: (t != "") & ~t.rlike(TAKE_TOKEN))


def combo_order(combo, strict: bool = True) -> Column:
    """Number of classes in a combination; `strict=False` counts raw `_` parts."""
    return F.size(parse_tokens(combo) if strict else F.split(combo, "_"))


def label_key(combo) -> Column:
    """Order-free identity of the label set, equal for `b_f` and `f_b`."""
    return F.array_join(F.array_sort(F.array_distinct(parse_tokens(combo))), "_")


def label_vector(tokens, classes: Sequence[str]) -> Column:
    """0/1 array in class order; tokens outside the catalog are ignored."""
    return F.array(*[F.array_contains(tokens, c).cast("int") for c in classes])


def class_catalog(images: DataFrame, combo: str = "combo") -> DataFrame:
    """(k, class): the sorted distinct tokens of all combinations.

    The distinct runs on combinations first, so what is ranked has one row per class.
    """
    tokens = (
        images.select(combo).distinct().select(F.explode(parse_tokens(combo)).alias("class")).distinct()
    )
    listed = tokens.agg(F.array_sort(F.collect_set("class")).alias("classes"))
    return listed.select(F.posexplode("classes").alias("k", "class"))


def class_names(images: DataFrame, combo: str = "combo") -> list[str]:
    """The catalog as a Python list (one row per class)."""
    return [r["class"] for r in class_catalog(images, combo).orderBy("k").collect()]


def with_labels(images: DataFrame, classes: Sequence[str]) -> DataFrame:
    return images.withColumn("label", label_vector(parse_tokens("combo"), classes))


def combo_label_map(images: DataFrame, classes: Sequence[str]) -> DataFrame:
    """One row per combination with its label vector."""
    return images.select("combo").distinct().withColumn("label", label_vector(parse_tokens("combo"), classes))


def combo_label_document(images: DataFrame, classes: Sequence[str]) -> DataFrame:
    """The same as one map column, the shape manifests carry."""
    pairs = combo_label_map(images, classes).select(F.struct("combo", "label").alias("e"))
    return pairs.agg(F.map_from_entries(F.array_sort(F.collect_list("e"))).alias("combo_to_label"))


def rewrite_prefix(path, old: str, new: str) -> Column:
    """Move `path` from below `old` to below `new`; other paths stay."""
    old, new = old.rstrip("/") + "/", new.rstrip("/") + "/"
    return F.when(
        F.startswith(path, F.lit(old)), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))
    ).otherwise(path)


def drop_class(label, k: int) -> Column:
    """Remove position `k` from a label or score vector."""
    return F.filter(label, lambda _, i: i != k)


def answer_found(picked, truth) -> Column:
    return F.size(F.array_intersect(picked, truth))


def answer_wrong(picked, truth) -> Column:
    return F.size(F.array_except(picked, truth))


def answer_perfect(picked, truth) -> Column:
    return (answer_wrong(picked, truth) == 0) & (F.size(F.array_except(truth, picked)) == 0)


def combo_role(combos: DataFrame, roles: DataFrame) -> DataFrame:
    """Attach each combination's protocol role, `unlisted` when it has none."""
    return combos.join(F.broadcast(roles.select("combo", "role")), "combo", "left").withColumn(
        "role", F.coalesce("role", F.lit("unlisted"))
    )


def incidence(combos: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Combination x class 0/1 matrix, one column per class."""
    label = label_vector(parse_tokens("combo"), classes)
    return combos.select("combo", label.alias("_l")).select(
        "combo", *[F.col("_l")[i].alias(c) for i, c in enumerate(classes)]
    )


def class_subsets(classes: Sequence[str], min_size: int = 2) -> Column:
    """Array of all subsets (each an array of names) with at least `min_size` members.

    The subsets are the bit masks 1 .. 2^K-1; the number of classes is the bound.
    """
    if len(classes) > 20:
        raise ValueError("class_subsets enumerates 2^K sets; K must stay at 20 or below")
    names = F.array(*[F.lit(c) for c in classes])
    masks = F.filter(
        F.sequence(F.lit(1), F.lit((1 << len(classes)) - 1)), lambda m: F.bit_count(m) >= min_size
    )
    bit = lambda m, i: F.call_function("shiftright", m, i).bitwiseAND(1) == 1
    return F.transform(masks, lambda m: F.filter(names, lambda _, i: bit(m, i)))
