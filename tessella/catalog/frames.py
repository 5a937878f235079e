"""Frame queries. Frames are made from the vectors: two 8 x 8 planes side by side."""

from pyspark.sql import functions as F

from tessella.catalog.fixtures import CLASSES, images, table, tiles
from tessella.catalog.jobs import split_images
from tessella.catalog.registry import query
from tessella.functions.labels import class_subsets
from tessella.operators import frames as FR
from tessella.operators import prototypes as P
from tessella.plans import ablations as A
from tessella.plans import decoders as D
from tessella.session import durable

H, W = 8, 16


def frames(spark, d, scale: int = 1):
    """(image_id, height, width, pixels); value = floor((e + 0.5) * 255 - 20 c), clamped.
    A half whose vector is missing is read as zeros. `scale` repeats every pixel."""
    t = tiles(spark, d).groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("tile_idx", "z"))).alias("m"))
    each = lambda n: F.sequence(F.lit(0), F.lit(n - 1))

    def pixel(y, x):
        """Six hexadecimal digits, made once for each number of a vector, whatever the scale."""
        e = F.coalesce(F.get(F.element_at(F.col("m"), F.shiftright(x, 3)), y * 8 + x.bitwiseAND(F.lit(7))).cast("double"), F.lit(0.0))
        value = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e + 0.5) * 255.0 - c * 20)))
        return F.repeat(F.concat(*[F.substring(F.hex((value(c) + 256).cast("bigint")), 2, 2) for c in range(3)]), F.lit(scale))

    row = lambda y: F.repeat(F.array_join(F.transform(each(W), lambda x: pixel(y, x)), ""), F.lit(scale))
    pixels = F.unhex(F.array_join(F.transform(each(H), row), ""))
    return t.select("image_id", F.lit(H * scale).alias("height"), F.lit(W * scale).alias("width"), pixels.alias("pixels"))


_PX = """WITH fe AS (SELECT image_id, half, embedding AS e FROM (SELECT DISTINCT vec_id // 2 AS image_id FROM embeddings), range(2) r(half) LEFT JOIN embeddings ON vec_id = image_id * 2 + half),
px AS (SELECT image_id, y, half * 8 + i AS x, c, greatest(0, least(255, floor((coalesce(e[y * 8 + i + 1]::DOUBLE, 0) + 0.5) * 255.0 - c * 20)))::INT AS v FROM fe, range(8) r(y), range(8) q(i), range(3) p(c))"""


def checksum(df):
    """Sum of pixel values weighted by (position mod 251) + 1."""
    return df.withColumn("checksum", FR.weighted_sum(F.col("pixels")))


@query("l1_grid_offsets", "doc_id:l i:l start:l", "SELECT doc_id, i, round_even(i * (n_chars - 32)::DOUBLE / 3, 0) AS start FROM documents, range(4) r(i) WHERE n_chars >= 32")
def l1(spark, d):
    docs = table(spark, d, "documents").where("n_chars >= 32")
    return docs.select("doc_id", F.posexplode(FR.grid_offsets(F.col("n_chars"), 32, 4)).alias("i", "start"))


@query("l2_grid_tiles", "image_id:l tile_idx:l y:l x:l checksum:l", f"""{_PX}, pl AS (SELECT image_id, r * 3 + c2 AS tile_idx, [0, 2, 4][r + 1] AS y0, [0, 6, 12][c2 + 1] AS x0 FROM (SELECT DISTINCT image_id FROM px), range(3) a(r), range(3) b(c2))
    SELECT pl.image_id, tile_idx, y0 AS y, x0 AS x, sum(v * ((((px.y - y0) * 4 + (px.x - x0)) * 3 + c) % 251 + 1)) AS checksum FROM pl JOIN px ON px.image_id = pl.image_id AND px.y BETWEEN y0 AND y0 + 3 AND px.x BETWEEN x0 AND x0 + 3 GROUP BY 1, 2, 3, 4""")
def l2(spark, d):
    return checksum(FR.grid_tiles(frames(spark, d), 4, 3))


@query("l2_tile_plan", "image_id:l tile_idx:l y:l x:l", f"{_PX} SELECT image_id, r * 3 + c2 AS tile_idx, [0, 2, 4][r + 1] AS y, [0, 6, 12][c2 + 1] AS x FROM (SELECT DISTINCT image_id FROM px), range(3) a(r), range(3) b(c2)")
def l2_plan(spark, d):
    return FR.tile_plan(frames(spark, d), 4, 3)


def _draw(what: str) -> str:
    return f"('0x' || md5(image_id::VARCHAR || ':' || t::VARCHAR || ':{what}:1337')[1:8])::BIGINT"


@query("l3_random_tiles", "image_id:l tile_idx:l y:l x:l checksum:l", f"""{_PX}, pl AS (SELECT image_id, t, {_draw('y')} % 4 AS y0, {_draw('x')} % 12 AS x0, {_draw('fx')} % 2 AS fx, {_draw('fy')} % 2 AS fy FROM (SELECT DISTINCT image_id FROM px), range(4) r(t)),
    g AS (SELECT pl.*, r, q FROM pl, range(5) a(r), range(5) b(q))
    SELECT g.image_id, t AS tile_idx, y0 AS y, x0 AS x, sum(v * (((r * 5 + q) * 3 + c) % 251 + 1)) AS checksum FROM g JOIN px ON px.image_id = g.image_id AND px.y = y0 + CASE WHEN fy = 1 THEN 4 - r ELSE r END AND px.x = x0 + CASE WHEN fx = 1 THEN 4 - q ELSE q END GROUP BY 1, 2, 3, 4""")
def l3(spark, d):
    return checksum(FR.random_tiles(frames(spark, d), 5, 4, 1337))


def _axis(n: int, name: str) -> str:
    """The axis matrix of a background with sigma 2 and half resolution: shrink by averaging with a triangle, blur with a mirrored Gaussian of sigma 1, grow linearly."""
    m = n // 2
    return f"""{name}_s0 AS (SELECT i, j, greatest(0.0, 1 - abs(j - ((i + 0.5::DOUBLE) * 2 - 0.5)) / 2) AS w FROM range({m}) a(i), range({n}) b(j)), {name}_s AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM {name}_s0),
{name}_k AS (SELECT o, exp(-0.5::DOUBLE * o * o) AS k FROM range(-4, 5) r(o)), {name}_b AS (SELECT i, CASE WHEN q < {m} THEN q ELSE {2 * m - 1} - q END AS j, sum(k) AS w FROM (SELECT i, ((i + o) % {2 * m} + {2 * m}) % {2 * m} AS q, k / (SELECT sum(k) FROM {name}_k) AS k FROM range({m}) a(i), {name}_k) GROUP BY 1, 2),
{name}_g0 AS (SELECT i, j, greatest(0.0, 1 - abs(j - ((i + 0.5::DOUBLE) / 2 - 0.5))) AS w FROM range({n}) a(i), range({m}) b(j)), {name}_g AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM {name}_g0),
{name} AS (SELECT g.i, s.j, sum(g.w * b.w * s.w) AS w FROM {name}_g g JOIN {name}_b b ON g.j = b.i JOIN {name}_s s ON b.j = s.i GROUP BY 1, 2)"""


_BG = f"""{_PX}, {_axis(8, 'my')}, {_axis(16, 'mx')}, b1 AS (SELECT image_id, c, my.i AS y, x, sum(w * v) AS v FROM px JOIN my ON my.j = y GROUP BY 1, 2, 3, 4), bg AS (SELECT image_id, c, y, mx.i AS x, sum(w * v) AS b FROM b1 JOIN mx ON mx.j = x GROUP BY 1, 2, 3, 4)"""


@query("l4_background", "image_id:l c:l mean:d lo:d hi:d", f"{_BG} SELECT image_id, c, avg(b) AS mean, min(b) AS lo, max(b) AS hi FROM bg GROUP BY 1, 2")
def l4(spark, d):
    return FR.background(frames(spark, d), 2.0, 2)


@query("l5_flatten_none", "image_id:l checksum:l", f"{_PX} SELECT image_id, sum(v * (((y * 16 + x) * 3 + c) % 251 + 1)) AS checksum FROM px GROUP BY 1")
def l5_none(spark, d):
    return checksum(FR.flatten_illumination(frames(spark, d), "none"))


@query("l5_flatten_divide", "image_id:l checksum:l", f"""{_BG}, me AS (SELECT image_id, avg(b) AS m FROM bg GROUP BY 1), fl AS (SELECT px.*, floor(least(255.0, greatest(0.0, v / (b + 1) * m)))::BIGINT AS o FROM px JOIN bg USING (image_id, y, x, c) JOIN me USING (image_id))
    SELECT image_id, sum(o * (((y * 16 + x) * 3 + c) % 251 + 1)) AS checksum FROM fl GROUP BY 1""")
def l5(spark, d):
    return checksum(FR.flatten_illumination(frames(spark, d), "divide", 2.0, 2))


_CORR = """co AS (SELECT image_id, y, x, c, name, sev, v, CASE name
  WHEN 'clean' THEN v WHEN 'brightness' THEN trunc(v * [0.85::DOUBLE, 0.70, 0.55][sev]) WHEN 'contrast' THEN trunc((v / 255.0::DOUBLE) ** [1.3::DOUBLE, 1.6, 2.0][sev] * 255.0)
  WHEN 'illum_gradient' THEN trunc(least(255.0, v * (x * (((1.0 + [0.15::DOUBLE, 0.3, 0.5][sev]) - (1.0 - [0.15::DOUBLE, 0.3, 0.5][sev])) / 15) + (1.0 - [0.15::DOUBLE, 0.3, 0.5][sev])))) END AS o
  FROM px, (VALUES ('clean', 0), ('brightness', 1), ('brightness', 3), ('contrast', 2), ('illum_gradient', 1), ('illum_gradient', 3)) n(name, sev))"""


@query("l6_corrupt", "image_id:l corruption:s severity:l checksum:l", f"{_PX}, {_CORR} SELECT image_id, name AS corruption, sev AS severity, sum(o::INT * (((y * 16 + x) * 3 + c) % 251 + 1)) AS checksum FROM co GROUP BY 1, 2, 3")
def l6(spark, d):
    names = [("clean", 0), ("brightness", 1), ("brightness", 3), ("contrast", 2), ("illum_gradient", 1), ("illum_gradient", 3)]
    return checksum(FR.corrupt(frames(spark, d), names))


@query("l6_corrupt_all", "image_id:l corruption:s severity:l checksum:l")
def l6_all(spark, d):
    return checksum(FR.corrupt(frames(spark, d)))


def _linear(n: int, name: str) -> str:
    return f"""{name}_0 AS (SELECT i, j, greatest(0.0, 1 - abs(j - greatest(0.0, least({n - 1}, (i + 0.5::DOUBLE) * {n} / 6 - 0.5)))) AS w FROM range(6) a(i), range({n}) b(j)), {name} AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM {name}_0)"""


@query("l7_resize_values", "image_id:l c:l y:l x:l v:d", f"{_PX}, {_linear(8, 'my')}, {_linear(16, 'mx')} SELECT image_id, c, my.i AS y, mx.i AS x, sum(my.w * mx.w * v) AS v FROM px JOIN my ON my.j = y JOIN mx ON mx.j = x GROUP BY 1, 2, 3, 4")
def l7_values(spark, d):
    """The values before they are cut to bytes."""
    import numpy as np
    from pyspark.sql import types as T

    rows = T.StructType([T.StructField("image_id", T.LongType()), *[T.StructField(n, T.IntegerType()) for n in ("c", "y", "x")], T.StructField("v", T.DoubleType())])

    def one(r):
        a = FR.both_axes(FR.pixels_of(r), FR.resize_matrix(r.height, 6, antialias=False), FR.resize_matrix(r.width, 6, antialias=False))
        for y, x, c in np.ndindex(a.shape):
            yield dict(image_id=r.image_id, c=c, y=y, x=x, v=float(a[y, x, c]))

    return FR.map_frames(frames(spark, d), one, rows)


@query("l7_resize", "image_id:l height:l width:l checksum:l")
def l7(spark, d):
    return checksum(FR.resize_frames(frames(spark, d), 6))


_TRF = """tf AS (SELECT image_id, t, v, CASE t WHEN 'identity' THEN (y * 16 + x) WHEN 'hflip' THEN (y * 16 + 15 - x) WHEN 'vflip' THEN ((7 - y) * 16 + x)
  WHEN 'rot90' THEN ((15 - x) * 8 + y) WHEN 'rot180' THEN ((7 - y) * 16 + 15 - x) ELSE (x * 8 + 7 - y) END * 3 + c AS pos FROM px, (VALUES ('identity'), ('rot90'), ('rot180'), ('rot270'), ('hflip'), ('vflip')) n(t))"""


@query("l8_transforms", "image_id:l transform:s checksum:l", f"{_PX}, {_TRF} SELECT image_id, t AS transform, sum(v * (pos % 251 + 1)) AS checksum FROM tf GROUP BY 1, 2")
def l8(spark, d):
    return checksum(FR.transform_frames(frames(spark, d)))


@query("l8_grayscale", "image_id:l checksum:l", f"{_PX}, g AS (SELECT image_id, y, x, (sum(v * [19595, 38470, 7471][c + 1]) + 32768)::BIGINT >> 16 AS l FROM px GROUP BY 1, 2, 3) SELECT image_id, sum(l * (((y * 16 + x) * 3 + c) % 251 + 1)) AS checksum FROM g, range(3) r(c) GROUP BY 1")
def l8_gray(spark, d):
    return checksum(FR.transform_frames(frames(spark, d), ("grayscale",)))


@query("l9_augment", "image_id:l aug_idx:l height:l width:l checksum:l")
def l9(spark, d):
    return checksum(FR.augment(frames(spark, d, 4), 3, 0.2, 12))


@query("l9_augment_todo", "combo:s n:l have:l", """WITH e AS (SELECT event_type AS combo, user_id FROM events), n AS (SELECT combo, count(*) AS n FROM e GROUP BY 1), h AS (SELECT combo, count(*) * 5 AS have FROM e WHERE user_id % 2 = 0 OR combo IN ('view', 'click') GROUP BY 1)
    SELECT combo, n, coalesce(have, 0) AS have FROM n LEFT JOIN h USING (combo) WHERE coalesce(have, 0) < n * 5""")
def l9_todo(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("combo"), "user_id")
    have = e.where((F.col("user_id") % 2 == 0) | F.col("combo").isin("view", "click")).withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(5))))
    return FR.augment_todo(e, have, 5)


def _pool(spark, d, scale=1):
    pure = images(spark, d).where(F.col("combo").isin(*CLASSES)).select("image_id", F.col("combo").alias("class"))
    return frames(spark, d, scale).join(pure, "image_id")


def _subsets(spark, d):
    sets = images(spark, d).select("combo").distinct().where("contains(combo, '_')")
    return sets.withColumn("tokens", F.split("combo", "_"))


@query("l10_mosaic", "combo:s mosaic:l tile_idx:l size:l checksum:l")
def l10(spark, d):
    return checksum(FR.mosaic(_pool(spark, d), _subsets(spark, d), 2, 7, quad=4))


@query("l10_mosaic_coverage", "combo:s mosaic:l classes:l slots:l", "WITH f AS (SELECT vec_id // 2 AS image_id, list_aggregate(list_sort(list(DISTINCT 'c' || CAST(label % 5 AS VARCHAR))), 'string_agg', '_') AS combo FROM embeddings GROUP BY 1) SELECT DISTINCT combo, m AS mosaic, len(string_split(combo, '_')) AS classes, 64 AS slots FROM f, range(2) r(m) WHERE contains(combo, '_')")
def l10_coverage(spark, d):
    """Every class of the combination fills at least one quadrant."""
    p = FR.mosaic_plan(_subsets(spark, d), 2, 7)
    return p.groupBy("combo", "mosaic").agg(F.countDistinct("class").alias("classes"), F.count("*").alias("slots"))


@query("l11_normalize_tiles", "image_id:l tile_idx:l j:l v:d", f"""{_PX} SELECT px.image_id, t AS tile_idx, (y * 8 + x - (t % 2) * 8) * 3 + c AS j, (v / 255.0::DOUBLE - [0.485::DOUBLE, 0.456, 0.406][c + 1]) / [0.229::DOUBLE, 0.224, 0.225][c + 1] AS v FROM px JOIN range(4) r(t) ON x // 8 = t % 2""")
def l11(spark, d):
    n = FR.normalize_tiles(FR.grid_tiles(frames(spark, d), 8, 2))
    return n.select("image_id", "tile_idx", F.posexplode("values").alias("j", "v"))


ENCODER = FR.ProjectionEncoder(16, 2, 3)


def embedded(spark, d, **kw):
    args = {"sigma": 2.0, "downsample": 2, **kw}
    return FR.embed_frames(frames(spark, d), ENCODER, 8, 2, **args)


@query("l12_embed_tiles", "image_id:l tile_idx:l j:l v:d")
def l12(spark, d):
    t = FR.embed_tiles(FR.grid_tiles(frames(spark, d), 8, 2), ENCODER)
    return t.select("image_id", "tile_idx", F.posexplode("z").alias("j", "v"))


@query("l12_embed_frames", "image_id:l tile_idx:l j:l v:d")
def l12_frames(spark, d):
    return embedded(spark, d).select("image_id", "tile_idx", F.posexplode("z").alias("j", "v"))


@query("l13_units", "granularity:s image_id:l tile_idx:l norm:d", f"""{_PX}, i AS (SELECT DISTINCT image_id FROM px), k AS (SELECT * FROM (VALUES ('cls8', 4), ('patchmean8', 4), ('patch8', 16), ('cls4', 9), ('patchmean4', 9), ('patch4', 36)) v(granularity, n))
    SELECT granularity, image_id, u AS tile_idx, 1.0 AS norm FROM i, k, range(36) r(u) WHERE u < n""")
def l13(spark, d):
    from tessella.functions.vectors import norm

    u = FR.units_from_tokens(frames(spark, d), FR.ProjectionEncoder(16, 2, 3, tokens=True), ((8, 2), (4, 3)), sigma=2.0, downsample=2)
    return u.withColumn("norm", norm(F.col("z")))


def _frame_model(spark, d, **kw):
    im, t = split_images(spark, d), durable(embedded(spark, d, **kw))  # read for prototypes and for thresholds
    return im, t, D.run_matching(im, t, CLASSES)[0]


@query("o15_robustness", "corruption:s decoder:s arm:s degradation:d")
def o15(spark, d):
    from tessella.operators.metrics import degradation

    im, t, m = _frame_model(spark, d)
    u, _ = D.run_unmix(im, t, CLASSES)
    test = im.where("split = 'test'")
    fr = frames(spark, d).join(test.select("image_id"), "image_id", "left_semi")
    return degradation(A.robustness(fr, test, {"match": m, "unmix": u}, ENCODER, 8, 2, sigma=2.0, downsample=2))


@query("o16_sweep_illumination", "arm:s method:s per_sample_f1:d macro_f1:d")
def o16_illum(spark, d):
    arms = {m: {"size": 8, "n": 2, "method": m, "sigma": 2.0, "downsample": 2} for m in ("divide", "subtract", "none")}
    return A.sweep_frames(split_images(spark, d), frames(spark, d), CLASSES, ENCODER, arms)


@query("o16_sweep_tile_size", "arm:s method:s per_sample_f1:d macro_f1:d")
def o16_size(spark, d):
    arms = {str(s): {"size": s, "n": n, "sigma": 2.0, "downsample": 2} for s, n in ((8, 2), (4, 4))}
    return A.sweep_frames(split_images(spark, d), frames(spark, d), CLASSES, ENCODER, arms)


@query("o17_invariance", "transform:s per_sample_f1:d macro_f1:d")
def o17_inv(spark, d):
    im, _, m = _frame_model(spark, d)
    test = im.where("split = 'test'")
    fr = frames(spark, d).join(test.select("image_id"), "image_id", "left_semi")
    return A.invariance(fr, test, m, ENCODER, 8, 2, sigma=2.0, downsample=2)[0]


@query("o17_grayscale", "k:l mean_a:d mean_b:d mean_drop:d margin_change:d")
def o17_gray(spark, d):
    im, _, m = _frame_model(spark, d)
    return A.grayscale_shift(frames(spark, d), im.where("split = 'test'"), m, ENCODER, 8, 2, sigma=2.0, downsample=2)
