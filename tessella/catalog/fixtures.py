"""The given tables read as a set-labelled image collection.

Two consecutive vectors form an image, five classes come from `label % 5`, and the set
of classes on an image is its combination. `bags=3, classes=4` gives combinations of up
to three classes. Everything scales with the `embeddings` table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLASSES = ("c0", "c1", "c2", "c3", "c4")
CLASSES4 = ("c0", "c1", "c2", "c3")
DIM = 64


_SCHEMAS: dict[tuple[str, str], T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table with its schema looked up once, so later reads start no inference job."""
    key = (sf_dir, name)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.read.schema(_SCHEMAS[key]).parquet(f"{sf_dir}/{name}.parquet")


def tiles(spark: SparkSession, sf_dir: str, bag: int = 2, classes: int = 5) -> DataFrame:
    """(image_id, tile_idx, class, z)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.floor(F.col("vec_id") / bag).cast("bigint").alias("image_id"),
        (F.col("vec_id") % bag).cast("int").alias("tile_idx"),
        F.concat(F.lit("c"), (F.col("label") % classes).cast("string")).alias("class"),
        F.col("embedding").alias("z"),
    )


def images(spark: SparkSession, sf_dir: str, bag: int = 2, classes: int = 5) -> DataFrame:
    """(image_id, combo, path, label); the vectors are not read for this."""
    from tessella.functions.labels import label_vector, parse_tokens

    t = tiles(spark, sf_dir, bag, classes)
    names = [f"c{k}" for k in range(classes)]
    combo = F.array_join(F.array_sort(F.collect_set("class")), "_")
    out = t.groupBy("image_id").agg(combo.alias("combo"))
    path = F.concat_ws("/", F.lit("frames"), "combo", F.format_string("%07d.jpg", "image_id"))
    return out.withColumn("path", path).withColumn("label", label_vector(parse_tokens("combo"), names))


# ---- SQL twins -------------------------------------------------------------------


def sql_tiles(bag: int = 2, classes: int = 5) -> str:
    return f"""fx_tiles AS (
  SELECT vec_id // {bag} AS image_id, CAST(vec_id % {bag} AS INT) AS tile_idx,
         'c' || CAST(label % {classes} AS VARCHAR) AS class,
         list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS z
  FROM embeddings)"""


def sql_images(classes: int = 5) -> str:
    names = ", ".join(f"'c{k}'" for k in range(classes))
    return f"""fx_combo AS (
  SELECT image_id, list_aggregate(list_sort(list(DISTINCT class)), 'string_agg', '_') AS combo
  FROM fx_tiles GROUP BY 1),
fx_images AS (
  SELECT image_id, combo, 'frames/' || combo || '/' || lpad(CAST(image_id AS VARCHAR), 7, '0') || '.jpg' AS path,
         list_transform([{names}], lambda c: CASE WHEN list_contains(string_split(combo, '_'), c) THEN 1 ELSE 0 END) AS label
  FROM fx_combo)"""


def sql_base(bag: int = 2, classes: int = 5) -> str:
    return "WITH " + sql_tiles(bag, classes) + ",\n" + sql_images(classes)


def sql_classes(classes: int = 5) -> str:
    rows = ", ".join(f"({k}, 'c{k}')" for k in range(classes))
    return f"cls(k, class) AS (VALUES {rows})"


def sql_unit(vec: str) -> str:
    return f"list_transform({vec}, lambda x: x / greatest(sqrt(list_inner_product({vec}, {vec})), 1e-12))"


def sql_protos(name: str = "protos", image_source: str = "fx_images", by: str = "", tile_source: str = "fx_tiles") -> str:
    """Hybrid prototypes (by, k, source, p); needs `cls` and the image source."""
    b = f"{by}, " if by else ""
    ib = f"i.{by}, " if by else ""
    return f"""{name}_rows AS (
  SELECT {ib}c.k, (i.combo = c.class) AS pure, t.z
  FROM {tile_source} t JOIN {image_source} i USING (image_id)
  JOIN cls c ON list_contains(string_split(i.combo, '_'), c.class)),
{name}_src AS (SELECT {b}k, max(CASE WHEN pure THEN 1 ELSE 0 END) AS has_pure FROM {name}_rows GROUP BY {b}k),
{name}_mean AS (
  SELECT {b}k, has_pure, d, avg(z[d]) AS m
  FROM {name}_rows JOIN {name}_src USING ({b}k), (SELECT unnest(range(1, {DIM + 1})) AS d)
  WHERE pure OR has_pure = 0 GROUP BY {b}k, has_pure, d),
{name}_vec AS (SELECT {b}k, has_pure, list(m ORDER BY d) AS v FROM {name}_mean GROUP BY {b}k, has_pure),
{name} AS (SELECT {b}k, CASE WHEN has_pure = 1 THEN 'pure' ELSE 'any' END AS source, {sql_unit('v')} AS p FROM {name}_vec)"""


def sql_sims(name: str = "sims", protos: str = "protos", by: str = "") -> str:
    """(by, image_id, tile_idx, s): cosine to every prototype in class order."""
    b = f"p.{by}, " if by else ""
    return f"""{name} AS (
  SELECT {b}t.image_id, t.tile_idx, any_value(t.z) AS z, list(list_inner_product(t.z, p.p) ORDER BY p.k) AS s
  FROM fx_tiles t, {protos} p GROUP BY {b}t.image_id, t.tile_idx)"""


def sql_sparsemax(src: str, name: str, keys: str = "image_id, tile_idx", s: str = "s", tau: float = 10.0) -> str:
    """Adds `w`, the sparsemax of tau * s, to every row of `src`."""
    return f"""{name}_desc AS (SELECT *, list_sort(list_transform({s}, lambda x: x * {tau}), 'DESC') AS dv FROM {src}),
{name}_cum AS (SELECT *, list_transform(dv, lambda x, r: list_sum(dv[1:r]) - 1.0) AS cv FROM {name}_desc),
{name}_sup AS (SELECT *, len(list_filter(list_transform(dv, lambda x, r: x - cv[r] / r), lambda d: d > 0)) AS sz FROM {name}_cum),
{name} AS (SELECT * EXCLUDE (dv, cv, sz), list_transform({s}, lambda x: greatest(x * {tau} - cv[sz] / sz, 0.0)) AS w FROM {name}_sup)"""


def sql_mean(src: str, name: str, vec: str = "s", by: str = "") -> str:
    """(by, image_id, k, score): tile mean per class."""
    b = f"{by}, " if by else ""
    return f"""{name} AS (
  SELECT {b}image_id, k, avg(v) AS score
  FROM (SELECT {b}image_id, unnest({vec}) AS v, unnest(range(len({vec}))) AS k FROM {src}) GROUP BY {b}image_id, k)"""


def sql_labelled(src: str, name: str, image_source: str = "fx_images") -> str:
    """Adds combo, label (0/1 of class k) to long scores."""
    return f"{name} AS (SELECT m.*, i.combo, i.label[m.k + 1] AS label FROM {src} m JOIN {image_source} i USING (image_id))"
