"""Per-tile scoring queries: prototypes from all images, every read-out of a tile."""

import numpy as np
from pyspark.sql import functions as F

from tessella.catalog.fixtures import (
    CLASSES,
    CLASSES4,
    images,
    sql_base,
    sql_classes,
    sql_mean,
    sql_labelled,
    sql_protos,
    sql_sims,
    sql_sparsemax,
    tiles,
)
from tessella.catalog.registry import query
from tessella.functions import vectors as V
from tessella.model import ChannelModel
from tessella.operators import metrics as M
from tessella.operators import prototypes as P
from tessella.operators import scoring as S

SIMS = f"{sql_base()}, {sql_classes()}, {sql_protos()}, {sql_sims()}"
WEIGHTS = f"{SIMS}, {sql_sparsemax('sims', 'wts')}"
RESIDUAL = f"""{WEIGHTS}, pmat AS (SELECT list(p ORDER BY k) AS pm FROM protos),
res AS (SELECT w.*, list_transform(range(1, 65), lambda d: z[d] - list_sum(list_transform(range(1, 6), lambda k: w[k] * pm[k][d]))) AS r FROM wts w, pmat),
resn AS (SELECT *, sqrt(list_inner_product(r, r)) AS residual FROM res)"""


def model(spark, d, tau=10.0):
    return P.hybrid_prototypes(tiles(spark, d), images(spark, d), CLASSES, tau)


def scored(spark, d, *outputs):
    return S.score_tiles(tiles(spark, d), model(spark, d), outputs)


@query("b9_l2_normalize", "image_id:l tile_idx:l d:l v:d", f"""WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE * (vec_id % 5)) AS z FROM embeddings)
    SELECT vec_id // 2 AS image_id, vec_id % 2 AS tile_idx, d, z[d + 1] / greatest(sqrt(list_inner_product(z, z)), 1e-12) AS v FROM x, range(64) r(d)""")
def b9(spark, d):
    """Includes all-zero vectors, which the norm floor keeps at zero."""
    scale = (F.col("image_id") * 2 + F.col("tile_idx")) % 5
    t = tiles(spark, d).withColumn("z", F.transform("z", lambda x: x.cast("double") * scale))
    return S.normalize_tiles(t).select("image_id", "tile_idx", F.posexplode("z").alias("d", "v"))


@query("b10_cosine", "image_id:l tile_idx:l k:l s:d", f"{SIMS} SELECT image_id, tile_idx, k, s[k + 1] AS s FROM sims, range(5) r(k)")
def b10(spark, d):
    return scored(spark, d, "sims").select("image_id", "tile_idx", F.posexplode("sims").alias("k", "s"))


@query("b11_best_class", "image_id:l tile_idx:l best:l max_sim:d", f"{SIMS} SELECT image_id, tile_idx, list_position(s, list_max(s)) - 1 AS best, list_max(s) AS max_sim FROM sims")
def b11(spark, d):
    return scored(spark, d, "best", "max_sim")


@query("b12_logits", "image_id:l tile_idx:l k:l one:d per_class:d", f"{SIMS} SELECT image_id, tile_idx, k, s[k + 1] * 10.0 AS one, s[k + 1] * (8.0 + k) AS per_class FROM sims, range(5) r(k)")
def b12(spark, d):
    taus = V.vector_literal([8.0, 9.0, 10.0, 11.0, 12.0])
    s = scored(spark, d, "sims").withColumn("e", F.arrays_zip(V.logits("sims", 10.0).alias("one"), V.logits("sims", taus).alias("per_class")))
    return s.select("image_id", "tile_idx", F.posexplode("e").alias("k", "e")).select("image_id", "tile_idx", "k", "e.*")


@query("b13_sparsemax", "image_id:l tile_idx:l k:l w:d", f"{WEIGHTS} SELECT image_id, tile_idx, k, w[k + 1] AS w FROM wts, range(5) r(k)")
def b13(spark, d):
    return scored(spark, d, "weights").select("image_id", "tile_idx", F.posexplode("weights").alias("k", "w"))


@query("b13_sparsemax_columns", "image_id:l tile_idx:l k:l w:d", f"{WEIGHTS} SELECT image_id, tile_idx, k, w[k + 1] AS w FROM wts, range(5) r(k)")
def b13_columns(spark, d):
    """The same projection as a pure Column expression on the cosine scores."""
    s = scored(spark, d, "sims")
    return s.select("image_id", "tile_idx", F.posexplode(V.sparsemax(V.logits("sims", 10.0))).alias("k", "w"))


@query("b14_softmax", "image_id:l tile_idx:l k:l w:d", f"""{SIMS}, e AS (SELECT image_id, tile_idx, list_transform(s, lambda x: exp((x - list_max(s)) * 10.0)) AS e FROM sims)
    SELECT image_id, tile_idx, k, e[k + 1] / list_sum(e) AS w FROM e, range(5) r(k)""")
def b14(spark, d):
    return scored(spark, d, "softmax").select("image_id", "tile_idx", F.posexplode("softmax").alias("k", "w"))


@query("b15_residual", "image_id:l tile_idx:l residual:d", f"{RESIDUAL} SELECT image_id, tile_idx, residual FROM resn")
def b15(spark, d):
    return scored(spark, d, "residual")


@query("b16_energy", "image_id:l tile_idx:l e_cold:d e_warm:d", f"""{SIMS} SELECT image_id, tile_idx,
    -(list_max(s) + 0.1 * ln(list_sum(list_transform(s, lambda x: exp((x - list_max(s)) / 0.1))))) AS e_cold,
    -(list_max(s) + ln(list_sum(list_transform(s, lambda x: exp(x - list_max(s)))))) AS e_warm FROM sims""")
def b16(spark, d):
    s = scored(spark, d, "energy@0.1", "energy@1.0")
    return s.select("image_id", "tile_idx", F.col("`energy@0.1`").alias("e_cold"), F.col("`energy@1.0`").alias("e_warm"))


@query("b17_neg_max", "image_id:l tile_idx:l neg_max:d", f"{SIMS} SELECT image_id, tile_idx, -list_max(s) AS neg_max FROM sims")
def b17(spark, d):
    return scored(spark, d, "neg_max")


# fixed toy weights for the channel head: both engines compute them from the same rule
def channel_model() -> ChannelModel:
    w = np.array([[((k * 16 + c) % 7 - 3) / 4.0 for c in range(16)] for k in range(4)])
    return ChannelModel(CLASSES4, w, np.array([0.1 * k for k in range(4)]))


CHANNEL = f"""{sql_base(2, 4)}, chl AS (SELECT image_id, tile_idx, k, 0.1 * k + list_sum(list_transform(range(16), lambda c: z[k * 16 + c + 1] * ((k * 16 + c) % 7 - 3) / 4.0)) AS logit FROM fx_tiles, range(4) r(k))"""


@query("b19_channel_logits", "image_id:l tile_idx:l k:l logit:d prob:d", f"{CHANNEL} SELECT image_id, tile_idx, k, logit, 1.0 / (1.0 + exp(-logit)) AS prob FROM chl")
def b19(spark, d):
    m = channel_model()
    t = S.normalize_tiles(tiles(spark, d, 2, 4))
    logits = V.channel_logits("z", m.weight.tolist(), m.bias.tolist())
    return t.select("image_id", "tile_idx", F.posexplode(logits).alias("k", "logit")).withColumn("prob", V.sigmoid(F.col("logit")))


@query("b18_sigmoid_head", "image_id:l k:l score:d", f"{CHANNEL} SELECT image_id, k, avg(1.0 / (1.0 + exp(-logit))) AS score FROM chl GROUP BY 1, 2")
def b18(spark, d):
    """The same head as an Arrow kernel, averaged over tiles."""
    m = S.tile_mean(S.score_head(tiles(spark, d, 2, 4), channel_model()), 4)
    return m.select("image_id", F.posexplode("scores").alias("k", "score"))


MEAN = f"{SIMS}, {sql_mean('sims', 'msc')}, {sql_labelled('msc', 'sc')}"


def image_scores(spark, d, *extras):
    """(image_id, combo, path, label, scores): mean cosine of all tiles."""
    m = model(spark, d)
    s = S.tile_mean(S.score_tiles(tiles(spark, d), m, ("sims", *extras)), m.k, extras=extras)
    return images(spark, d).join(s, "image_id")


@query("b20_presence", "image_id:l k:l present:l", f"{MEAN} SELECT image_id, k, CASE WHEN score > (CASE k WHEN 1 THEN 0.1 WHEN 3 THEN -0.02 ELSE 0.05 END) THEN 1 ELSE 0 END AS present FROM sc")
def b20(spark, d):
    from tessella.operators.calibrate import predict_presence

    known = spark.createDataFrame([("c1", 0.1), ("c3", -0.02)], "class string, threshold double")
    return predict_presence(image_scores(spark, d), CLASSES, known).select("image_id", F.posexplode("pred").alias("k", "present"))


@query("b21_presence_fixed", "image_id:l k:l present:l", f"""{CHANNEL} SELECT image_id, k, CASE WHEN round(avg(logit), 1) >= 0.2 THEN 1 ELSE 0 END AS present FROM chl GROUP BY 1, 2""")
def b21(spark, d):
    m = channel_model()
    t = S.normalize_tiles(tiles(spark, d, 2, 4)).withColumn("l", V.channel_logits("z", m.weight.tolist(), m.bias.tolist()))
    s = S.tile_mean(t, 4, "l").withColumn("scores", F.transform("scores", lambda x: F.round(x, 1)))
    return s.select("image_id", F.posexplode(V.presence_fixed("scores", 0.2)).alias("k", "present"))


@query("b22_unknown", "image_id:l by_residual:b by_similarity:b", f"""{RESIDUAL} SELECT image_id, avg(residual) > 0.9 AS by_residual, avg(list_max(s)) < 0.2 AS by_similarity FROM resn GROUP BY 1""")
def b22(spark, d):
    s = S.tile_mean(scored(spark, d, "sims", "residual", "max_sim"), 5, extras=("residual", "max_sim"))
    return s.select(
        "image_id",
        V.unknown_by_residual(F.col("residual"), 0.9).alias("by_residual"),
        V.unknown_by_similarity(F.col("max_sim"), 0.2).alias("by_similarity"),
    )


@query("b23_margin", "image_id:l own:l margin:d is_best:b", f"""{MEAN}, o AS (SELECT image_id, k AS own, score FROM sc WHERE label = 1)
    SELECT o.image_id, own, o.score - max(s.score) AS margin, o.score >= max(s.score) AS is_best FROM o JOIN sc s ON s.image_id = o.image_id AND s.k <> o.own GROUP BY o.image_id, own, o.score""")
def b23(spark, d):
    s = image_scores(spark, d).select("image_id", "scores", F.posexplode("label").alias("own", "present")).where("present = 1")
    return s.select("image_id", "own", V.own_margin(F.col("scores"), F.col("own")).alias("margin"), V.own_is_best(F.col("scores"), F.col("own")).alias("is_best"))


@query("b24_class_normalise", "image_id:l tile_idx:l residual_norm:d", f"""{RESIDUAL}, near AS (SELECT *, list_position(s, list_max(s)) - 1 AS best FROM resn),
    ref AS (SELECT i.combo, greatest(quantile_disc(residual, 0.5), 1e-6) AS ref FROM near JOIN fx_images i USING (image_id) WHERE len(string_split(i.combo, '_')) = 1 GROUP BY 1)
    SELECT image_id, tile_idx, residual / coalesce(ref, 1.0) AS residual_norm FROM near LEFT JOIN ref ON ref.combo = 'c' || CAST(best AS VARCHAR)""")
def b24(spark, d):
    s = scored(spark, d, "residual", "best")
    pure = s.join(images(spark, d), "image_id").select(F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("combo")).alias("k"), "residual")
    refs = M.class_references(pure.where("k > 0").withColumn("k", (F.col("k") - 1).cast("int")), CLASSES, "residual")
    return M.class_normalise(s, refs, "residual")


@query("b25_project", "image_id:l tile_idx:l j:l v:d", f"""{sql_base()}, pr AS (SELECT image_id, tile_idx, list_transform(range(4), lambda j: list_sum(list_transform(range(64), lambda c: z[c + 1] * ((j * 5 + c) % 9 - 4)))) AS y FROM fx_tiles)
    SELECT image_id, tile_idx, j, y[j + 1] / greatest(sqrt(list_inner_product(y, y)), 1e-12) AS v FROM pr, range(4) r(j)""")
def b25(spark, d):
    w = np.array([[(j * 5 + c) % 9 - 4 for c in range(64)] for j in range(4)], dtype=float)
    return S.project(S.normalize_tiles(tiles(spark, d)), w).select("image_id", "tile_idx", F.posexplode("z").alias("j", "v"))


@query("b26_combined_metric", "image_id:l combined:d", f"{MEAN} SELECT image_id, 0.25 * max(score) + 0.75 * min(score) AS combined FROM sc GROUP BY 1")
def b26(spark, d):
    s = image_scores(spark, d)
    return s.select("image_id", V.combined_metric(F.array_max("scores"), F.array_min("scores"), 0.25).alias("combined"))


@query("b27_central_tiles", "image_id:l tile_idx:l", "SELECT vec_id // 16 AS image_id, vec_id % 16 AS tile_idx FROM embeddings WHERE vec_id % 16 IN (5, 6, 9, 10)")
def b27(spark, d):
    return tiles(spark, d, bag=16).where(V.is_central_tile(F.col("tile_idx"))).select("image_id", "tile_idx")
