"""Join and aggregation queries."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessella.catalog.fixtures import CLASSES, CLASSES4, images, sql_base, sql_classes, sql_labelled, sql_mean, sql_protos, sql_sims, sql_sparsemax, table, tiles
from tessella.catalog.registry import query
from tessella.catalog.vectors import MEAN, RESIDUAL, SIMS, WEIGHTS, image_scores, model, scored
from tessella.operators import metrics as M
from tessella.operators import prototypes as P
from tessella.operators import scoring as S
from tessella.operators import calibrate as C

THR = "thr AS (SELECT k, coalesce(quantile_cont(score, 0.05) FILTER (WHERE label = 1), 0.05) AS t FROM sc GROUP BY k)"
PRED = f"{MEAN}, {THR}, pr AS (SELECT sc.*, CASE WHEN score > t THEN 1 ELSE 0 END AS pred FROM sc JOIN thr USING (k))"
PER_IMAGE = """pi AS (SELECT image_id, any_value(combo) AS combo, sum(pred * label) AS tp, sum(pred * (1 - label)) AS fp, sum((1 - pred) * label) AS fn,
  bool_and(pred = label) AS em, sum(pred) AS np, sum(label) AS nt FROM pr GROUP BY 1),
f AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 1.0 END AS f1 FROM pi)"""
PER_CLASS = """pk AS (SELECT k, sum(pred * label) AS tp, sum(pred * (1 - label)) AS fp, sum((1 - pred) * label) AS fn, sum((1 - pred) * (1 - label)) AS tn FROM pr GROUP BY 1),
fk AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM pk)"""


def predictions(spark, d):
    """image_scores plus `pred` at the 5 % quantile of each class's positives."""
    s = image_scores(spark, d)
    return C.apply_thresholds(s, C.quantile_thresholds(s, 0.05, 0.05))


@query("c1_label_tiles", "image_id:l tile_idx:l combo:s", f"{sql_base()} SELECT image_id, tile_idx, combo FROM fx_tiles JOIN fx_images USING (image_id)")
def c1(spark, d):
    return P.labelled_tiles(tiles(spark, d).drop("z"), images(spark, d))


@query("c2_semi", "image_id:l tile_idx:l", f"{sql_base()} SELECT image_id, tile_idx FROM fx_tiles WHERE image_id IN (SELECT image_id FROM fx_images WHERE combo LIKE '%c3%')")
def c2(spark, d):
    chosen = images(spark, d).where(F.col("combo").contains("c3"))
    return tiles(spark, d).select("image_id", "tile_idx").join(chosen, "image_id", "left_semi")


@query("d1_tile_mean", "image_id:l k:l score:d", f"{MEAN} SELECT image_id, k, score FROM sc")
def d1(spark, d):
    return image_scores(spark, d).select("image_id", F.posexplode("scores").alias("k", "score"))


@query("d1_empty_images", "image_id:l k:l score:d", f"""{SIMS}, {sql_mean('sims', 'msc')}, every AS (SELECT DISTINCT user_id AS image_id FROM events)
    SELECT every.image_id, r.k, coalesce(score, 0.0) AS score FROM every CROSS JOIN range(5) r(k) LEFT JOIN msc ON msc.image_id = every.image_id AND msc.k = r.k""")
def d1_empty(spark, d):
    """Images without tiles score zero."""
    m = model(spark, d)
    s = S.tile_mean(S.score_tiles(tiles(spark, d), m), m.k)
    every = table(spark, d, "events").select(F.col("user_id").alias("image_id")).distinct()
    return S.with_empty_images(s, every, m.k).select("image_id", F.posexplode("scores").alias("k", "score"))


_AGG = "SELECT image_id, k, {f} AS score FROM (SELECT vec_id // 16 AS image_id, s.k, s.v FROM (SELECT image_id * 2 + tile_idx AS vec_id, unnest(range(5)) AS k, unnest(s) AS v FROM sims) s) GROUP BY 1, 2"


def _sixteen(spark, d):
    s = scored(spark, d, "sims")
    return s.withColumn("image_id", F.floor((F.col("image_id") * 2 + F.col("tile_idx")) / 16).cast("bigint"))


@query("d2_tile_q90", "image_id:l k:l score:d", f"{SIMS} " + _AGG.format(f="quantile_cont(v, 0.9)"))
def d2(spark, d):
    """Sixteen tiles per image."""
    return S.aggregate_tiles(_sixteen(spark, d), 5, "q90").select("image_id", F.posexplode("scores").alias("k", "score"))


@query("d2_tile_q90_hot", "image_id:l k:l score:d", f"{SIMS} SELECT image_id % 3 AS image_id, k, quantile_cont(v, 0.9) AS score FROM (SELECT image_id, unnest(range(5)) AS k, unnest(s) AS v FROM sims) GROUP BY 1, 2")
def d2_hot(spark, d):
    """Three images hold everything, so the distributed order statistics answer."""
    s = scored(spark, d, "sims").withColumn("image_id", F.col("image_id") % 3)
    return S.tile_quantile(s, 5, 0.9, hot_rows=100).select("image_id", F.posexplode("scores").alias("k", "score"))


@query("d2_tile_max", "image_id:l k:l score:d", f"{SIMS} " + _AGG.format(f="max(v)"))
def d2_max(spark, d):
    return S.aggregate_tiles(_sixteen(spark, d), 5, "max").select("image_id", F.posexplode("scores").alias("k", "score"))


@query("d4_mean_vector", "class:s d:l m:d n:l", f"{sql_base()} SELECT class, d, avg(z[d + 1]) AS m, count(*) AS n FROM fx_tiles, range(64) r(d) GROUP BY 1, 2")
def d4(spark, d):
    return P.mean_vector(tiles(spark, d), ["class"]).select("class", "n", F.posexplode("mean").alias("d", "m"))


@query("d5_proto_sums", "k:l source:s d:l v:d n:l", f"""{sql_base()}, {sql_classes()}, rw AS (SELECT k, combo = class AS pure, z FROM fx_tiles JOIN fx_images i USING (image_id) JOIN cls ON list_contains(string_split(combo, '_'), cls.class)),
    bo AS (SELECT k, 'any' AS source, z FROM rw UNION ALL SELECT k, 'pure' AS source, z FROM rw WHERE pure)
    SELECT k, source, d, sum(z[d + 1]) AS v, count(*) AS n FROM bo, range(64) r(d) GROUP BY 1, 2, 3""".replace("fx_images i USING", "fx_images USING").replace("combo = class AS", "combo = cls.class AS"))
def d5(spark, d):
    s = P.prototype_sums(tiles(spark, d), images(spark, d), CLASSES)
    return s.select("k", "source", "n", F.posexplode("s").alias("d", "v"))


_SEEDS = """WITH m AS (SELECT CAST(user_id % 3 AS VARCHAR) AS method, user_id % 5 AS seed, CASE WHEN event_id % 2 = 0 THEN 'val' ELSE 'test' END AS split,
  CASE WHEN event_type = 'error' THEN CAST('NaN' AS DOUBLE) ELSE value END AS v FROM events), a AS (SELECT method, seed, split, avg(v) FILTER (WHERE NOT isnan(v)) AS value FROM m GROUP BY 1, 2, 3)"""


def _seed_metrics(spark, d):
    e = table(spark, d, "events")
    v = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    e = e.select((F.col("user_id") % 3).cast("string").alias("method"), (F.col("user_id") % 5).alias("seed"),
                 F.when(F.col("event_id") % 2 == 0, "val").otherwise("test").alias("split"), v.alias("value"))
    return e


@query("d7_mean_std", "method:s mean:d std:d n:l", _SEEDS + " SELECT method, avg(v) FILTER (WHERE NOT isnan(v)) AS mean, stddev_pop(v) FILTER (WHERE NOT isnan(v)) AS std, count(v) FILTER (WHERE NOT isnan(v)) AS n FROM m GROUP BY 1")
def d7(spark, d):
    return M.mean_std(_seed_metrics(spark, d), ["method"])


@query("d8_delta_by_seed", "method:s mean:d std:d n:l", _SEEDS + """, w AS (SELECT method, seed, max(value) FILTER (WHERE split = 'val') - max(value) FILTER (WHERE split = 'test') AS delta FROM a GROUP BY 1, 2)
    SELECT method, avg(delta) AS mean, stddev_pop(delta) AS std, count(delta) AS n FROM w GROUP BY 1""")
def d8(spark, d):
    per = _seed_metrics(spark, d).where(~F.isnan("value")).groupBy("method", "seed", "split").agg(F.avg("value").alias("value"))
    return M.delta_by_seed(per)


@query("d9_by_order", "ord:l A_mean:d A_std:d A_n:l B_mean:d B_std:d B_n:l", f"""{PRED}, {PER_IMAGE}, pc AS (SELECT combo, avg(f1) AS f1 FROM f GROUP BY 1),
    cn AS (SELECT combo, avg(2.0::DOUBLE * nt / (5 + nt)) AS f1 FROM f GROUP BY 1), u AS (SELECT 'A' AS m, * FROM pc UNION ALL SELECT 'B', * FROM cn)
    SELECT len(string_split(combo, '_')) AS ord, avg(f1) FILTER (WHERE m = 'A') AS A_mean, stddev_pop(f1) FILTER (WHERE m = 'A') AS A_std, count(f1) FILTER (WHERE m = 'A') AS A_n,
      avg(f1) FILTER (WHERE m = 'B') AS B_mean, stddev_pop(f1) FILTER (WHERE m = 'B') AS B_std, count(f1) FILTER (WHERE m = 'B') AS B_n FROM u GROUP BY 1""")
def d9(spark, d):
    """Prototype matching (A) against the all-present predictor (B)."""
    p = predictions(spark, d)
    ones = p.withColumn("pred", F.transform("label", lambda _: F.lit(1)))
    both = M.per_combo(p).withColumn("method", F.lit("A")).unionByName(M.per_combo(ones).withColumn("method", F.lit("B")))
    return M.by_order(both, ["A", "B"]).withColumnRenamed("order", "ord")


@query("d10_sparsity", "sparsity:d", f"{WEIGHTS} SELECT avg(CASE WHEN abs(x) <= 1e-8 THEN 1.0::DOUBLE ELSE 0 END) AS sparsity FROM (SELECT unnest(w) AS x FROM wts)")
def d10(spark, d):
    return S.sparsity(scored(spark, d, "weights"))


@query("d11_separation", "k:l mean_pos:d mean_neg:d separation:d", f"{MEAN} SELECT k, avg(score) FILTER (WHERE label = 1) AS mean_pos, avg(score) FILTER (WHERE label = 0) AS mean_neg, avg(score) FILTER (WHERE label = 1) - avg(score) FILTER (WHERE label = 0) AS separation FROM sc GROUP BY 1")
def d11(spark, d):
    return M.separation(image_scores(spark, d))


@query("d12_confusion", "k:l fpr:d fnr:d tpr:d n_pos:l n_neg:l", f"{PRED}, {PER_CLASS} SELECT k, fp / (fp + tn) AS fpr, fn / (tp + fn) AS fnr, tp / (tp + fn) AS tpr, tp + fn AS n_pos, fp + tn AS n_neg FROM pk")
def d12(spark, d):
    return M.confusion_rates(predictions(spark, d))


@query("d13_label_noise", "k:l fnr_singleton:d n_singleton:l fnr_mixture:d n_mixture:l upper_bound:d", f"""{PRED}, n AS (SELECT k, avg(1 - pred) FILTER (WHERE label = 1 AND NOT contains(combo, '_')) AS fnr_singleton, count(*) FILTER (WHERE label = 1 AND NOT contains(combo, '_')) AS n_singleton,
      avg(1 - pred) FILTER (WHERE label = 1 AND contains(combo, '_')) AS fnr_mixture, count(*) FILTER (WHERE label = 1 AND contains(combo, '_')) AS n_mixture FROM pr GROUP BY 1)
    SELECT *, greatest(fnr_mixture - fnr_singleton, 0.0) AS upper_bound FROM n""")
def d13(spark, d):
    return M.label_noise_bound(predictions(spark, d))


@query("d13_label_noise_summary", "mean_upper_bound:d max_upper_bound:d", f"""{PRED}, n AS (SELECT k, greatest(avg(1 - pred) FILTER (WHERE label = 1 AND contains(combo, '_')) - avg(1 - pred) FILTER (WHERE label = 1 AND NOT contains(combo, '_')), 0.0) AS b FROM pr GROUP BY 1)
    SELECT avg(b) AS mean_upper_bound, max(b) AS max_upper_bound FROM n""")
def d13s(spark, d):
    return M.label_noise_summary(predictions(spark, d))


@query("d14_cardinality", "mean_predicted:d mean_true:d", f"{PRED}, {PER_IMAGE} SELECT avg(np) AS mean_predicted, avg(nt) AS mean_true FROM f")
def d14(spark, d):
    return M.cardinality(predictions(spark, d))


@query("d16_degradation", "corruption:s decoder:s arm:s degradation:d", """WITH c AS (SELECT CASE user_id % 4 WHEN 0 THEN 'clean' WHEN 1 THEN 'blur' WHEN 2 THEN 'noise' ELSE 'gamma' END AS corruption, user_id // 4 % 3 AS severity,
      CASE WHEN event_type IN ('view', 'click') THEN 'A' ELSE 'B' END AS decoder, CASE WHEN event_id % 2 = 0 THEN 'divide' ELSE 'none' END AS arm, value FROM events),
    s AS (SELECT corruption, CASE WHEN corruption = 'clean' THEN 0 ELSE severity END AS severity, decoder, arm, avg(value) AS f1 FROM c GROUP BY 1, 2, 3, 4)
    SELECT a.corruption, a.decoder, a.arm, avg(a.f1) - any_value(b.f1) AS degradation FROM s a JOIN s b ON b.corruption = 'clean' AND a.decoder = b.decoder AND a.arm = b.arm WHERE a.corruption <> 'clean' GROUP BY 1, 2, 3""")
def d16(spark, d):
    e = table(spark, d, "events")
    u = F.col("user_id") % 4
    name = F.when(u == 0, "clean").when(u == 1, "blur").when(u == 2, "noise").otherwise("gamma")
    sev = F.when(u == 0, F.lit(0)).otherwise(F.floor(F.col("user_id") / 4) % 3)
    rows = e.groupBy(name.alias("corruption"), sev.alias("severity"), F.when(F.col("event_type").isin("view", "click"), "A").otherwise("B").alias("decoder"),
                     F.when(F.col("event_id") % 2 == 0, "divide").otherwise("none").alias("arm")).agg(F.avg("value").alias("f1"))
    return M.degradation(rows)


@query("d17_lower_median", "k:l ref:d", f"""{RESIDUAL} SELECT CAST(i.combo[2:] AS BIGINT) AS k, greatest(quantile_disc(residual, 0.5), 1e-6) AS ref FROM resn JOIN fx_images i USING (image_id) WHERE NOT contains(i.combo, '_') GROUP BY 1""")
def d17(spark, d):
    at = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("combo")) - 1
    pure = scored(spark, d, "residual").join(images(spark, d), "image_id").withColumn("k", at).where("k >= 0")
    return M.class_references(pure, CLASSES, "residual")


# tiles 0 and 1 of an image play the role of two transforms of it
@query("d18_tta_mean", "image_id:l k:l score:d", f"{MEAN} SELECT image_id, k, score FROM sc")
def d18(spark, d):
    s = scored(spark, d, "sims").select("image_id", F.col("tile_idx").alias("transform"), F.col("sims").alias("scores"))
    return M.tta_mean(s, 5).select("image_id", F.posexplode("scores").alias("k", "score"))


@query("d19_mean_pairwise_sim", "mean_sim:d", f"{SIMS} SELECT avg(list_inner_product(a.p, b.p)) AS mean_sim FROM protos a JOIN protos b ON a.k <> b.k")
def d19(spark, d):
    return spark.createDataFrame([(P.mean_pairwise_sim(model(spark, d)),)], "mean_sim double")


_T16 = "t16 AS (SELECT (image_id * 2 + tile_idx) // 4 AS image_id, (image_id * 2 + tile_idx) % 4 AS tr, s FROM sims)"


def _transforms(spark, d):
    v = F.col("image_id") * 2 + F.col("tile_idx")
    return scored(spark, d, "sims").select(F.floor(v / 4).cast("bigint").alias("image_id"), (v % 4).alias("transform"), F.col("sims").alias("scores"))


@query("d20_pairwise_l1", "t1:l t2:l l1:d", f"""{SIMS}, {_T16} SELECT a.tr AS t1, b.tr AS t2, avg(abs(a.s[k + 1] - b.s[k + 1])) AS l1 FROM t16 a JOIN t16 b ON a.image_id = b.image_id AND a.tr < b.tr, range(5) r(k) GROUP BY 1, 2""")
def d20(spark, d):
    return M.pairwise_l1(_transforms(spark, d))


@query("c6_pair_scores", "image_id:l t1:l t2:l gap:d", f"{SIMS}, {_T16} SELECT a.image_id, a.tr AS t1, b.tr AS t2, list_sum(list_transform(range(1, 6), lambda i: abs(a.s[i] - b.s[i]))) AS gap FROM t16 a JOIN t16 b ON a.image_id = b.image_id AND a.tr < b.tr")
def c6(spark, d):
    gap = F.aggregate(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda t, v: t + v)
    return M.pair_scores(_transforms(spark, d)).withColumn("gap", gap)


@query("e8_best_per", "event_type:s event_id:l value:d", "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def e8(spark, d):
    return M.best_per(table(spark, d, "events").select("event_type", "event_id", "value"), ["event_type"], "value", "event_id")


_RUNS = "WITH m AS (SELECT user_id, avg(value) AS f1, max(value) AS top FROM events GROUP BY 1)"


@query("e9_flag_best", "user_id:l best_f1:b best_top:b", _RUNS + " SELECT user_id, f1 >= max(f1) OVER () - 1e-6 AS best_f1, top >= max(top) OVER () - 1e-6 AS best_top FROM m")
def e9(spark, d):
    m = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("f1"), F.max("value").alias("top"))
    return M.flag_best(m, ["f1", "top"])


@query("g2_leaderboard", "user_id:l f1:d", _RUNS + " SELECT user_id, f1 FROM m ORDER BY f1 DESC, user_id LIMIT 10")
def g2(spark, d):
    m = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("f1"))
    return M.leaderboard(m, "f1", "user_id", 10)


@query("s2_pool_union", "unit_pos:l n:l", "SELECT vec_id % 2 AS unit_pos, count(*) + count(*) FILTER (WHERE label % 5 = 0) AS n FROM embeddings GROUP BY 1")
def s2(spark, d):
    """A real pool joined by a derived one."""
    real = tiles(spark, d).withColumnRenamed("tile_idx", "unit_pos")
    derived = real.where("class = 'c0'")
    return real.unionByName(derived).groupBy("unit_pos").agg(F.count("*").alias("n"))


@query("o7_score_units", "image_id:l key:s k:l score:d residual:d", f"""{RESIDUAL}, u AS (SELECT image_id, residual, unnest(range(5)) AS k, unnest(s) AS s, unnest(w) AS w FROM resn),
    a AS (SELECT image_id, k, avg(s) AS cm, quantile_cont(s, 0.9) AS cq, max(s) AS cx, avg(w) AS sm, quantile_cont(w, 0.9) AS sq, max(w) AS sx, avg(residual) AS residual FROM u GROUP BY 1, 2)
    SELECT image_id, k, residual, unnest(['cosine/mean', 'cosine/q90', 'cosine/max', 'sparsemax/mean', 'sparsemax/q90', 'sparsemax/max']) AS key, unnest([cm, cq, cx, sm, sq, sx]) AS score FROM a""")
def o7(spark, d):
    s = S.score_units(tiles(spark, d), model(spark, d))
    return s.select("image_id", "key", "residual", F.posexplode("scores").alias("k", "score"))
