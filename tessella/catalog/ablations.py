"""Sweep, ablation and fitting queries on the vectors."""

import numpy as np
from pyspark.sql import functions as F

from tessella.catalog.fixtures import CLASSES, CLASSES4, images, sql_mean, sql_labelled, sql_sparsemax, tiles
from tessella.catalog.jobs import _TRAINED, split_images
from tessella.catalog.registry import query
from tessella.operators import clusters as CL
from tessella.operators import fit as FT
from tessella.operators import prototypes as P
from tessella.operators import scoring as S
from tessella.plans import ablations as A
from tessella.plans import decoders as D
from tessella.session import durable


def trained(spark, d):
    im, t = split_images(spark, d), tiles(spark, d)
    return im, t, P.hybrid_prototypes(t, im.where("split = 'train'"), CLASSES)


_MS = """ms AS (SELECT image_id, 'match' AS method, unnest(range(5)) AS k, unnest(s) AS v FROM wts UNION ALL SELECT image_id, 'unmix', unnest(range(5)), unnest(w) FROM wts),
sc AS (SELECT method, image_id, k, avg(v) AS score, any_value(split) AS split, any_value(label[k + 1]) AS label FROM ms JOIN spl USING (image_id) GROUP BY 1, 2, 3)"""


@query("o16_sweep_quantile", "q:d method:s per_sample_f1:d macro_f1:d exact_match:d", f"""{_TRAINED}, {sql_sparsemax('sims', 'wts')}, {_MS}, qs AS (SELECT * FROM (VALUES (1, 0.01::DOUBLE), (2, 0.05), (3, 0.1), (4, 0.2)) v(i, q)),
    thr AS (SELECT method, q, k, coalesce((quantile_cont(score, [0.01, 0.05, 0.1, 0.2]) FILTER (WHERE label = 1))[i], 0.05) AS t FROM sc, qs WHERE split = 'val' GROUP BY method, q, i, k),
    pr AS (SELECT sc.*, q, CASE WHEN score > t THEN 1 ELSE 0 END AS pred FROM sc JOIN thr USING (method, k) WHERE split = 'test'),
    f AS (SELECT method, q, image_id, CASE WHEN sum(pred + label) > 0 THEN 2.0::DOUBLE * sum(pred * label) / sum(pred + label) ELSE 1.0 END AS f1, bool_and(pred = label) AS em FROM pr GROUP BY 1, 2, 3),
    fk AS (SELECT method, q, k, 2.0::DOUBLE * sum(pred * label) / greatest(sum(pred + label), 1) AS f1 FROM pr GROUP BY 1, 2, 3)
    SELECT q, method, avg(f1) AS per_sample_f1, (SELECT avg(f1) FROM fk WHERE fk.method = f.method AND fk.q = f.q) AS macro_f1, avg(CASE WHEN em THEN 1.0::DOUBLE ELSE 0 END) AS exact_match FROM f GROUP BY q, method""")
def o16_q(spark, d):
    return A.sweep_quantile(*trained(spark, d))


@query("o16_sweep_tile_count", "t:l method:s per_sample_f1:d", f"""{_TRAINED}, {sql_sparsemax('sims', 'wts')}, rk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY md5(CAST(image_id AS VARCHAR) || ':' || CAST(tile_idx AS VARCHAR) || ':1337'), tile_idx) AS r FROM wts),
    ms AS (SELECT t, image_id, 'match' AS method, unnest(range(5)) AS k, unnest(s) AS v FROM rk, (VALUES (1), (2)) c(t) WHERE r <= t UNION ALL SELECT t, image_id, 'unmix', unnest(range(5)), unnest(w) FROM rk, (VALUES (1), (2)) c(t) WHERE r <= t),
    sc AS (SELECT t, method, image_id, k, avg(v) AS score, any_value(split) AS split, any_value(label[k + 1]) AS label FROM ms JOIN spl USING (image_id) GROUP BY 1, 2, 3, 4),
    thr AS (SELECT t, method, k, coalesce(quantile_cont(score, 0.05) FILTER (WHERE label = 1), 0.05) AS h FROM sc WHERE split = 'val' GROUP BY 1, 2, 3),
    f AS (SELECT t, method, image_id, CASE WHEN sum(label + CASE WHEN score > h THEN 1 ELSE 0 END) > 0 THEN 2.0::DOUBLE * sum(CASE WHEN score > h THEN label ELSE 0 END) / sum(label + CASE WHEN score > h THEN 1 ELSE 0 END) ELSE 1.0 END AS f1 FROM sc JOIN thr USING (t, method, k) WHERE split = 'test' GROUP BY 1, 2, 3)
    SELECT t, method, avg(f1) AS per_sample_f1 FROM f GROUP BY 1, 2""")
def o16_t(spark, d):
    return A.sweep_tile_count(*trained(spark, d), counts=(1, 2))


@query("o16_sweep_projection", "method:s per_sample_f1:d", f"""{_TRAINED}, {sql_sparsemax('sims', 'wts')}, sm AS (SELECT *, list_transform(s, lambda x: exp((x - list_max(s)) * 10.0)) AS e FROM wts),
    ms AS (SELECT image_id, 'softmax' AS method, unnest(range(5)) AS k, unnest(list_transform(e, lambda x: x / list_sum(e))) AS v FROM sm UNION ALL SELECT image_id, 'unmix', unnest(range(5)), unnest(w) FROM sm),
    sc AS (SELECT method, image_id, k, avg(v) AS score, any_value(split) AS split, any_value(label[k + 1]) AS label FROM ms JOIN spl USING (image_id) GROUP BY 1, 2, 3),
    thr AS (SELECT method, k, coalesce(quantile_cont(score, 0.05) FILTER (WHERE label = 1), 0.05) AS h FROM sc WHERE split = 'val' GROUP BY 1, 2),
    f AS (SELECT method, image_id, CASE WHEN sum(label + CASE WHEN score > h THEN 1 ELSE 0 END) > 0 THEN 2.0::DOUBLE * sum(CASE WHEN score > h THEN label ELSE 0 END) / sum(label + CASE WHEN score > h THEN 1 ELSE 0 END) ELSE 1.0 END AS f1 FROM sc JOIN thr USING (method, k) WHERE split = 'test' GROUP BY 1, 2)
    SELECT method, avg(f1) AS per_sample_f1 FROM f GROUP BY 1""")
def o16_p(spark, d):
    return A.sweep_projection(*trained(spark, d))


@query("o16_sweep_init", "init:s method:s per_sample_f1:d")
def o16_i(spark, d):
    im, t, _ = trained(spark, d)
    return A.sweep_init(im, t, CLASSES)


@query("o17_boundary_tiles", "tiles:s per_sample_f1:d macro_f1:d")
def o17_b(spark, d):
    """Sixteen tiles per image, labels by the majority-free set rule of the wider bag."""
    t = tiles(spark, d, bag=16)
    im = split_images(spark, d, bag=16)
    return A.boundary_tiles(im, t, P.hybrid_prototypes(t, im.where("split = 'train'"), CLASSES))


@query("o17_isotonic", "variant:s per_sample_f1:d macro_f1:d auroc_mean:d")
def o17_iso(spark, d):
    im, t, m = trained(spark, d)
    return A.isotonic_effect(D.image_scores(t, im.where("split <> 'train'"), m).select("image_id", "split", "label", "scores"), CLASSES)


@query("o17_learned_tau", "variant:s per_sample_f1:d proto_sim:d")
def o17_tau(spark, d):
    im, t, _ = trained(spark, d)
    return A.fit_sweep(im, t, CLASSES, {"fixed": {}, "learned": {"learn_tau": True}}, epochs=30)


@query("o17_repulsion", "variant:s per_sample_f1:d proto_sim:d")
def o17_rep(spark, d):
    im, t, _ = trained(spark, d)
    return A.fit_sweep(im, t, CLASSES, {f"lambda={v}": {"repulsion_lambda": v} for v in (0.0, 0.1)}, epochs=30)


def _history(spark, rows):
    return spark.createDataFrame([(h["epoch"], float(h["loss"])) for h in rows], "epoch int, loss double")


def _labelled(spark, d, classes=5):
    im = split_images(spark, d, 2, classes).where("split = 'train'")
    return D.labelled_tiles(tiles(spark, d, 2, classes), im)


@query("n1_fit_unmix", "epoch:l loss:d")
def n1(spark, d):
    im, t, m = trained(spark, d)
    return _history(spark, FT.fit_unmix(_labelled(spark, d).drop("label"), m, 30, 1e-2, "element_mean").history)


@query("n2_fit_absent", "epoch:l loss:d")
def n2(spark, d):
    _, _, m = trained(spark, d)
    return _history(spark, FT.fit_unmix(_labelled(spark, d), m, 30, 1e-2, absent_lambda=1.0).history)


@query("n5_fit_discover", "class:s n:l")
def n5(spark, d):
    """Every three epochs high-residual tiles are clustered and appended."""
    _, _, m = trained(spark, d)
    discover = lambda rows, model: CL.propose_prototypes(rows, model, 0.9, "greedy", similarity=0.25, min_size=8)
    fitted = FT.fit_unmix(_labelled(spark, d).drop("label"), m, 4, 1e-2, discover_every=3, discover=discover).model
    return spark.createDataFrame([(c, fitted.dim) for c in fitted.classes], "class string, n int")


@query("n6_fit_subspace", "d:l per_sample_f1:d")
def n6(spark, d):
    im, t, _ = trained(spark, d)
    return A.subspace_stage(im, t, CLASSES, dims=(32, 64), epochs=30)


@query("n7_fit_channel", "epoch:l loss:d")
def n7(spark, d):
    """Asymmetric loss with channel dropout and tile mixup."""
    _, h = FT.fit_channel_head(_labelled(spark, d, 4), CLASSES4, 30, loss="asl", mixup_alpha=0.4)
    return _history(spark, h)


@query("n8_refine_uno", "i:l d:l v:d")
def n8(spark, d):
    _, t, m = trained(spark, d)
    rows = CL.gated_rows(t, m, 0.9)
    c = FT.refine_uno(rows, m.matrix[:2])
    return _matrix(spark, c)


def _matrix(spark, c):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(c)], "i int, v array<double>").select("i", F.posexplode("v").alias("d", "v"))


@query("n9_refine_simgcd", "i:l d:l v:d")
def n9(spark, d):
    im, t, m = trained(spark, d)
    known = m.without(0)
    train = _labelled(spark, d).where("label[0] = 0").withColumn("label", F.slice("label", 2, 4))
    test = t.join(im.where("split = 'test'").select("image_id"), "image_id", "left_semi")
    centre = CL.sinkhorn_cluster(CL.gated_rows(test, known, 0.9), 1)
    return _matrix(spark, FT.refine_simgcd(train, test, known, centre))


@query("n10_refine_kd", "i:l d:l v:d")
def n10(spark, d):
    im, t, m = trained(spark, d)
    test = t.join(im.where("split = 'test'").select("image_id"), "image_id", "left_semi")
    centre = CL.sinkhorn_cluster(CL.gated_rows(test, m.without(0), 0.9), 1)
    return _matrix(spark, FT.refine_kd(test, m.without(0), centre))


@query("o18_compare_encoders", "encoder:s rule:s split:s metric:s value:d")
def o18(spark, d):
    """Two encoders: the vectors, and their first half."""
    im, t, _ = trained(spark, d)
    half = t.withColumn("z", F.slice("z", 1, 32))
    return D.compare_encoders({"full": t, "half": half}, im, CLASSES, lr_grid=(0.1, 1.0))


@query("o19_mil", "split:s metric:s value:d")
def o19(spark, d):
    im, t, _ = trained(spark, d)
    return D.run_mil(im, t, CLASSES, lr=1e-2, check_every=5)[1]


@query("e7_softmax_over", "image_id:l tile_idx:l attention:d", """WITH t AS (SELECT vec_id // 2 AS image_id, vec_id % 2 AS tile_idx, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS z FROM embeddings),
    e AS (SELECT image_id, tile_idx, list_sum(list_transform(range(2), lambda l: (l + 1) * (2.0 / (1.0 + exp(-2.0 * list_sum(list_transform(range(64), lambda c: z[c + 1] * ((c * (l + 2)) % 5 - 2))))) - 1.0) / (1.0 + exp(-list_sum(list_transform(range(64), lambda c: z[c + 1] * ((c + l) % 3 - 1))))))) AS e FROM t)
    SELECT image_id, tile_idx, exp(e - max(e) OVER w) / sum(exp(e)) OVER w * exp(max(e) OVER w) AS attention FROM e WINDOW w AS (PARTITION BY image_id)""")
def e7(spark, d):
    """Gated attention with fixed weights: softmax of the energies within an image."""
    return FT.attention_weights(tiles(spark, d), attention_model())


def attention_model():
    v = np.array([[(c * (l + 2)) % 5 - 2 for c in range(64)] for l in range(2)], dtype=float)
    u = np.array([[(c + l) % 3 - 1 for c in range(64)] for l in range(2)], dtype=float)
    return FT.AttentionModel(CLASSES, v, u, np.array([1.0, 2.0]), np.zeros((5, 64)), np.zeros(5))


_ENERGY = """WITH t AS (SELECT vec_id // 2 AS image_id, vec_id % 2 AS tile_idx, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS z FROM embeddings),
    e AS (SELECT image_id, tile_idx, list_sum(list_transform(range(2), lambda l: (l + 1) * (2.0 / (1.0 + exp(-2.0 * list_sum(list_transform(range(64), lambda c: z[c + 1] * ((c * (l + 2)) % 5 - 2))))) - 1.0) / (1.0 + exp(-list_sum(list_transform(range(64), lambda c: z[c + 1] * ((c + l) % 3 - 1))))))) AS e FROM t)"""


@query("d3_attention_pool", "image_id:l d:l v:d", f"""{_ENERGY}, w AS (SELECT image_id, tile_idx, exp(e) / sum(exp(e)) OVER (PARTITION BY image_id) AS a FROM e)
    SELECT image_id, d, sum(a * z[d + 1]) AS v FROM w JOIN t USING (image_id, tile_idx), range(64) r(d) GROUP BY 1, 2""")
def d3(spark, d):
    """Attention-weighted means of the tiles of an image."""
    return FT.attention_pool(tiles(spark, d), attention_model()).select("image_id", F.posexplode("bag").alias("d", "v"))


@query("d3_attention_bags", "image_id:l d:l v:d", f"""{_ENERGY}, w AS (SELECT image_id, tile_idx, exp(e) / sum(exp(e)) OVER (PARTITION BY image_id) AS a FROM e)
    SELECT image_id, d, sum(a * z[d + 1]) AS v FROM w JOIN t USING (image_id, tile_idx), range(64) r(d) GROUP BY 1, 2""")
def d3_bags(spark, d):
    """The same from bags, images in parts of one tile."""
    from tessella.operators import bags

    return bags.pool_bags(bags.make_bags(tiles(spark, d), 1), attention_model()).select("image_id", F.posexplode("bag").alias("d", "v"))


# ---- clustering ------------------------------------------------------------------


@query("m3_kmeans", "k:l norm:d")
def m3(spark, d):
    m = P.kmeans_prototypes(tiles(spark, d), 5)
    return spark.createDataFrame([(k, float(np.linalg.norm(r))) for k, r in enumerate(m.matrix)], "k int, norm double")


@query("m4_random_rows", "k:l d:l v:d", """WITH r AS (SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER (ORDER BY md5(CAST(vec_id // 2 AS VARCHAR) || ':' || CAST(vec_id % 2 AS VARCHAR) || ':1337')) - 1 AS k FROM embeddings)
    SELECT k, d, e[d + 1] / sqrt(list_inner_product(e, e)) AS v FROM r, range(64) q(d) WHERE k < 5""")
def m4(spark, d):
    m = P.random_prototypes(tiles(spark, d), 5)
    return _matrix(spark, m.matrix).withColumnRenamed("i", "k")


@query("m7_sinkhorn", "image_id:l tile_idx:l k:l q:d", """WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS z FROM embeddings), c AS (SELECT vec_id AS k, z AS p FROM t WHERE vec_id < 3),
    q0 AS (SELECT t.vec_id, k, exp(list_inner_product(z, p) / 0.05) AS q FROM t, c), n AS (SELECT count(*) AS b FROM t),
    r1 AS (SELECT vec_id, k, q / sum(q) OVER (PARTITION BY k) / 3 AS q FROM q0), c1 AS (SELECT vec_id, k, q / sum(q) OVER (PARTITION BY vec_id) / b AS q FROM r1, n),
    r2 AS (SELECT vec_id, k, q / sum(q) OVER (PARTITION BY k) / 3 AS q FROM c1), c2 AS (SELECT vec_id, k, q / sum(q) OVER (PARTITION BY vec_id) / b AS q FROM r2, n),
    r3 AS (SELECT vec_id, k, q / sum(q) OVER (PARTITION BY k) / 3 AS q FROM c2), c3 AS (SELECT vec_id, k, q / sum(q) OVER (PARTITION BY vec_id) AS q FROM r3)
    SELECT vec_id // 2 AS image_id, vec_id % 2 AS tile_idx, k, q FROM c3""")
def m7(spark, d):
    """Balanced assignment to the first three vectors."""
    t = tiles(spark, d)
    first = t.where("image_id < 2").orderBy("image_id", "tile_idx").limit(3).collect()
    centres = S.unit_rows(np.array([r["z"] for r in first], dtype=float))
    return CL.sinkhorn_assign(t, centres).select("image_id", "tile_idx", F.posexplode("q").alias("k", "q"))


@query("m8_sinkhorn_k1", "d:l v:d", """WITH t AS (SELECT list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS z FROM embeddings),
    m AS (SELECT list(m ORDER BY d) AS v FROM (SELECT d, avg(z[d]) AS m FROM t, range(1, 65) r(d) GROUP BY 1)) SELECT d, v[d + 1] / sqrt(list_inner_product(v, v)) AS v FROM m, range(64) r(d)""")
def m8(spark, d):
    return _matrix(spark, CL.sinkhorn_cluster(tiles(spark, d), 1)).select("d", "v")


@query("m9_greedy_clusters", "i:l d:l v:d", """WITH RECURSIVE t AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS z FROM embeddings),
    nb AS (SELECT a.vec_id AS id, list(b.vec_id ORDER BY b.vec_id) AS f FROM t a JOIN t b ON b.vec_id >= a.vec_id AND list_inner_product(a.z, b.z) > 0.25 GROUP BY 1 HAVING count(*) >= 6),
    cand AS (SELECT id, f, row_number() OVER (ORDER BY id) AS rn FROM nb),
    walk(rn, taken, own) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[] UNION ALL
      SELECT rn, CASE WHEN len(free) >= 6 AND NOT list_contains(taken, id) THEN list_concat(taken, free) ELSE taken END, CASE WHEN len(free) >= 6 AND NOT list_contains(taken, id) THEN free ELSE [] END
      FROM (SELECT c.rn, c.id, w.taken, list_filter(c.f, lambda x: NOT list_contains(w.taken, x)) AS free FROM walk w JOIN cand c ON c.rn = w.rn + 1)),
    led AS (SELECT rn, own, row_number() OVER (ORDER BY rn) - 1 AS i FROM walk WHERE len(own) > 0), mem AS (SELECT i, unnest(own) AS vec_id FROM led)
    SELECT i, d, avg(z[d + 1]) AS v FROM mem JOIN t USING (vec_id), range(64) r(d) GROUP BY 1, 2""")
def m9(spark, d):
    t = tiles(spark, d).withColumn("row_id", F.col("image_id") * 2 + F.col("tile_idx"))
    return _matrix(spark, CL.greedy_clusters(t, 0.25, 6))


@query("m11_assign_images", "image_id:l best:l max_sim:d", f"{_TRAINED}, {sql_mean('sims', 'msc')} SELECT image_id, arg_max(k, {{'a': score, 'b': -k}}) AS best, max(score) AS max_sim FROM msc GROUP BY 1")
def m11(spark, d):
    _, t, m = trained(spark, d)
    return CL.assign_images(t, m)


@query("m12_pca", "i:l d:l load:d")
def m12(spark, d):
    """Squared loadings, so the sign of a direction does not matter."""
    return _matrix(spark, P.pca_basis(tiles(spark, d), 4) ** 2).withColumnRenamed("v", "load")


@query("n13_best_checkpoint", "run_id:l epoch:l val_f1:d", "SELECT run_id, epoch, val_f1 FROM (SELECT user_id % 11 AS run_id, event_id AS epoch, value AS val_f1, row_number() OVER (PARTITION BY user_id % 11 ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def n13(spark, d):
    from tessella.catalog.fixtures import table

    e = table(spark, d, "events")
    return FT.best_checkpoint(e.select((F.col("user_id") % 11).alias("run_id"), F.col("event_id").alias("epoch"), F.col("value").alias("val_f1")))


@query("m5_init_auto", "k:l source:s d:l v:d", f"{_TRAINED} SELECT k, source, d, p[d + 1] AS v FROM protos, range(64) r(d)")
def m5(spark, d):
    """Every class has a pure culture in training, so `auto` takes the pure means."""
    im, t = split_images(spark, d), tiles(spark, d)
    m = P.init_prototypes(t, im.where("split = 'train'"), CLASSES, "auto")
    return P.prototype_table(spark, m).select("k", "source", F.posexplode("p").alias("d", "v"))


@query("o9_mosaic_stage", "pool:s per_sample_f1:d")
def o9_mosaic(spark, d):
    """Unmixing fitted on real units, on mosaics of pure frames, and on both."""
    from tessella.catalog import frames as CF
    from tessella.functions.labels import label_vector
    from tessella.operators import frames as FR

    im, t = split_images(spark, d), durable(CF.embedded(spark, d, method="none"))
    real = D.labelled_tiles(t, im.where("split = 'train'"))
    sets = CF._subsets(spark, d)
    of_mosaic = F.xxhash64("combo", "mosaic").alias("image_id")
    label = F.transform(label_vector(F.split("combo", "_"), CLASSES), lambda x: x.cast("double"))
    labels = FR.mosaic_plan(sets, 2, 7).select("combo", "mosaic").distinct().select(of_mosaic, label.alias("label"))  # without pixels
    tiles_ = FR.mosaic(CF._pool(spark, d), sets, 2, 7, quad=4).select(of_mosaic, "tile_idx", "size", "pixels")
    return A.mosaic_stage(real, FR.embed_tiles(tiles_, CF.ENCODER).join(labels, "image_id"), im, t, CLASSES, epochs=30, absent_lambda=0.5)
