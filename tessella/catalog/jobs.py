"""End-to-end job queries: decoders, leave-combinations-out, open set, discovery."""

from pyspark.sql import functions as F

from tessella.catalog.aggregates import PER_CLASS, PER_IMAGE
from tessella.catalog.fixtures import (
    CLASSES,
    CLASSES4,
    images,
    sql_base,
    sql_classes,
    sql_labelled,
    sql_mean,
    sql_protos,
    sql_sims,
    sql_sparsemax,
    sql_unit,
    tiles,
)
from tessella.catalog.metrics import _AUC, _ROC
from tessella.catalog.registry import query
from tessella.catalog.splits import _FOLD, LCO, LCO_SPLIT, sql_heldout
from tessella.catalog.vectors import channel_model
from tessella.operators import metrics as M
from tessella.operators import prototypes as P
from tessella.operators import scoring as S
from tessella.operators import splits as SP
from tessella.plans import decoders as D
from tessella.plans import lco as L
from tessella.plans import openset as O

# a fixed split by image number: three fifths train, one fifth each for val and test
_SPL = "spl AS (SELECT *, CASE image_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM fx_images), trn AS (SELECT * FROM spl WHERE split = 'train')"


def split_images(spark, d, bag=2, classes=5):
    r = F.col("image_id") % 5
    return images(spark, d, bag, classes).withColumn("split", F.when(r == 0, "test").when(r == 1, "val").otherwise("train"))


_TRAINED = f"{sql_base()}, {sql_classes()}, {_SPL}, {sql_protos('protos', 'trn')}, {sql_sims()}"
_COS = f"{_TRAINED}, {sql_mean('sims', 'msc')}, {sql_labelled('msc', 'sc', 'spl').replace('SELECT m.*', 'SELECT m.*, i.split')}"
_SPX = f"{_TRAINED}, {sql_sparsemax('sims', 'wts')}, {sql_mean('wts', 'msc', 'w')}, {sql_labelled('msc', 'sc', 'spl').replace('SELECT m.*', 'SELECT m.*, i.split')}"
_VALTHR = "thr AS (SELECT k, coalesce(quantile_cont(score, 0.05) FILTER (WHERE label = 1), {fb}) AS t FROM sc WHERE split = 'val' GROUP BY k)"
_BUNDLE = """SELECT split, metric, value FROM (SELECT '{split}' AS split, (SELECT avg(f1) FROM f) AS per_sample_f1, (SELECT avg(f1) FROM fk) AS macro_f1, (SELECT avg(CASE WHEN em THEN 1.0::DOUBLE ELSE 0 END) FROM f) AS exact_match,
  (SELECT avg(np) FROM f) AS mean_predicted, (SELECT avg(nt) FROM f) AS mean_true) UNPIVOT (value FOR metric IN (per_sample_f1, macro_f1, exact_match, mean_predicted, mean_true))"""


def _pred(split: str) -> str:
    return f"pr AS (SELECT sc.*, CASE WHEN score > t THEN 1 ELSE 0 END AS pred FROM sc JOIN thr USING (k) WHERE split = '{split}')"


@query("o1_matching", "split:s metric:s value:d", f"{_COS}, {_VALTHR.format(fb=0.5)}, {_pred('val')}, {PER_IMAGE}, {PER_CLASS} {_BUNDLE.format(split='val')}")
def o1(spark, d):
    return D.run_matching(split_images(spark, d), tiles(spark, d), CLASSES)[1]


@query("o1_matching_model", "k:l source:s threshold:d unknown_threshold:d", f"{_COS}, {_VALTHR.format(fb=0.5)}, mx AS (SELECT image_id, avg(list_max(s)) AS m FROM sims JOIN spl USING (image_id) WHERE split = 'val' GROUP BY 1) SELECT k, source, t AS threshold, (SELECT quantile_cont(m, 0.05) FROM mx) AS unknown_threshold FROM thr JOIN protos USING (k)")
def o1_model(spark, d):
    m, _ = D.run_matching(split_images(spark, d), tiles(spark, d), CLASSES)
    rows = [(k, m.source[k], m.thresholds[k], m.unknown_threshold) for k in range(m.k)]
    return spark.createDataFrame(rows, "k int, source string, threshold double, unknown_threshold double")


@query("o2_unmix_init", "split:s metric:s value:d", f"{_SPX}, {_VALTHR.format(fb=0.05)}, {_pred('val')}, {PER_IMAGE}, {PER_CLASS} {_BUNDLE.format(split='val')}")
def o2(spark, d):
    return D.run_unmix(split_images(spark, d), tiles(spark, d), CLASSES)[1]


@query("o2_unmix_trained", "split:s metric:s value:d")
def o2_trained(spark, d):
    """Thirty gradient epochs with the absent-mass penalty."""
    return D.run_unmix(split_images(spark, d), tiles(spark, d), CLASSES, epochs=30, absent_lambda=0.5)[1]


@query("o3_channel_head", "split:s metric:s value:d")
def o3(spark, d):
    """Four-class channel heads, thirty epochs with channel dropout."""
    return D.run_channel_head(split_images(spark, d, 2, 4), tiles(spark, d, 2, 4), CLASSES4)[1]


@query("o3_channel_head_fixed", "split:s metric:s value:d", f"""{sql_base(2, 4)}, {_SPL}, chl AS (SELECT image_id, k, 1.0 / (1.0 + exp(-(0.1 * k + list_sum(list_transform(range(16), lambda c: z[k * 16 + c + 1] * ((k * 16 + c) % 7 - 3) / 4.0))))) AS p FROM fx_tiles, range(4) r(k)),
    sc AS (SELECT image_id, k, avg(p) AS score, any_value(split) AS split, any_value(combo) AS combo, any_value(label[k + 1]) AS label FROM chl JOIN spl USING (image_id) GROUP BY 1, 2),
    g AS (SELECT k, t, sum(CASE WHEN score > t THEN label ELSE 0 END) AS tp, sum(CASE WHEN score > t THEN 1 - label ELSE 0 END) AS fp, sum(CASE WHEN score > t THEN 0 ELSE label END) AS fn FROM sc, (SELECT 0.01 + i * ((0.99 - 0.01)::DOUBLE / 98) AS t FROM range(99) r(i)) WHERE split = 'val' GROUP BY 1, 2),
    thr AS (SELECT k, arg_max(t, {{'a': CASE WHEN 2 * tp + fp + fn > 0 THEN round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 12) ELSE 0 END, 'b': -t}}) AS t FROM g GROUP BY 1), {_pred('test')}, {PER_IMAGE}, {PER_CLASS} {_BUNDLE.format(split='test')}""")
def o3_fixed(spark, d):
    """Given weights, thresholds by best F1 on val, reported on test."""
    _, m = D.run_channel_head(split_images(spark, d, 2, 4), tiles(spark, d, 2, 4), CLASSES4, channel_model())
    return m.where("split = 'test'")


@query("o4_presence", "image_id:l k:l score:d pred:l", f"{_COS}, {_VALTHR.format(fb=0.5)}, {_pred('test')} SELECT image_id, k, score, pred FROM pr")
def o4(spark, d):
    im, t = split_images(spark, d), tiles(spark, d)
    model, _ = D.run_matching(im, t, CLASSES)
    p = D.detect_presence(model, im.where("split = 'test'"), t)
    return p.select("image_id", F.posexplode(F.arrays_zip("scores", "pred")).alias("k", "e")).select("image_id", "k", F.col("e.scores").alias("score"), "e.pred")


# ---- leave combinations out ------------------------------------------------------

_LCO_SC = f"""{sql_base()}, {sql_classes()}, {LCO}, {LCO_SPLIT}, trn AS (SELECT * FROM sp WHERE split = 'train'), {sql_protos('protos', 'trn')}, {sql_sims()}, {sql_sparsemax('sims', 'wts')},
ms AS (SELECT image_id, 'match' AS method, unnest(range(5)) AS k, unnest(s) AS v FROM wts UNION ALL SELECT image_id, 'unmix', unnest(range(5)), unnest(w) FROM wts),
sc AS (SELECT method, image_id, k, avg(v) AS score, any_value(combo) AS combo, any_value(split) AS split, any_value(label[k + 1]) AS label FROM ms JOIN sp USING (image_id) GROUP BY 1, 2, 3),
thr AS (SELECT method, k, coalesce(quantile_cont(score, 0.05) FILTER (WHERE label = 1), max(score) + 1) AS t FROM sc WHERE split = 'val' GROUP BY 1, 2),
pr AS (SELECT sc.*, CASE WHEN score > t THEN 1 ELSE 0 END AS pred FROM sc JOIN thr USING (method, k) WHERE split <> 'train'),
f AS (SELECT method, split, image_id, any_value(combo) AS combo, bool_and(pred = label) AS em, CASE WHEN sum(pred + label) > 0 THEN 2.0::DOUBLE * sum(pred * label) / sum(pred + label) ELSE 1.0 END AS f1 FROM pr GROUP BY 1, 2, 3)"""
_LCO_OUT = "count(*) AS n, avg(f1) AS per_sample_f1, avg(CASE WHEN em THEN 1.0::DOUBLE ELSE 0 END) AS exact_match FROM f"


@query("o6_lco", "method:s split:s scope:s key:s n:l per_sample_f1:d exact_match:d", f"""{_LCO_SC}
    SELECT method, split, 'total' AS scope, '' AS key, {_LCO_OUT} GROUP BY method, split UNION ALL SELECT method, split, 'combo' AS scope, combo AS key, {_LCO_OUT} GROUP BY method, split, combo""")
def o6(spark, d):
    p = L.evaluate_lco(images(spark, d), tiles(spark, d), CLASSES, (1337,), {1: 1, 2: 2})
    return L.lco_report(p)


def _seed_part(s: int) -> str:
    """Held-out combinations and split of a seed, under names of their own."""
    split = LCO_SPLIT.replace("tr AS", f"tr{s} AS").replace("sp AS", f"sp{s} AS").replace("FROM tr", f"FROM tr{s}").replace("JOIN lco", f"JOIN lco{s}").replace(":1338", f":{s + 1}")
    return f"{sql_heldout({1: 1, 2: 2}, s, name=f'lco{s}')}, {split}"


_SEEDS = (1337, 1338, 1339)
_LCO_SEEDS = f"""{sql_base()}, {sql_classes()}, {', '.join(map(_seed_part, _SEEDS))}, sp AS ({' UNION ALL '.join(f'SELECT {s} AS seed, * FROM sp{s}' for s in _SEEDS)}), trn AS (SELECT * FROM sp WHERE split = 'train'),
{sql_protos('protos', 'trn', 'seed')}, {sql_sims('sims', 'protos', 'seed')}, {sql_sparsemax('sims', 'wts')},
ms AS (SELECT seed, image_id, 'match' AS method, unnest(range(5)) AS k, unnest(s) AS v FROM wts UNION ALL SELECT seed, image_id, 'unmix', unnest(range(5)), unnest(w) FROM wts),
sc AS (SELECT seed, method, image_id, k, avg(v) AS score, any_value(split) AS split, any_value(label[k + 1]) AS label FROM ms JOIN sp USING (seed, image_id) WHERE split <> 'train' GROUP BY 1, 2, 3, 4),
thr AS (SELECT seed, method, k, coalesce(quantile_cont(score, 0.05) FILTER (WHERE label = 1), max(score) + 1) AS t FROM sc WHERE split = 'val' GROUP BY 1, 2, 3),
pr AS (SELECT sc.*, CASE WHEN score > t THEN 1 ELSE 0 END AS pred FROM sc JOIN thr USING (seed, method, k)),
f AS (SELECT seed, method, split, image_id, CASE WHEN sum(pred + label) > 0 THEN 2.0::DOUBLE * sum(pred * label) / sum(pred + label) ELSE 1.0 END AS f1 FROM pr GROUP BY 1, 2, 3, 4),
v AS (SELECT seed, method, split AS quantity, avg(f1) AS v FROM f GROUP BY 1, 2, 3), dl AS (SELECT a.seed, a.method, 'delta' AS quantity, a.v - b.v AS v FROM v a JOIN v b USING (seed, method) WHERE a.quantity = 'val' AND b.quantity = 'test')"""


@query("o6_lco_seeds", "method:s quantity:s mean:d std:d n:l", f"{_LCO_SEEDS} SELECT method, quantity, avg(v) AS mean, stddev_pop(v) AS std, count(v) AS n FROM (SELECT * FROM v UNION ALL SELECT * FROM dl) GROUP BY 1, 2")
def o6_seeds(spark, d):
    """Three partitions in one pass, rolled up with the in-distribution minus held-out gap."""
    p = L.evaluate_lco(images(spark, d), tiles(spark, d), CLASSES, (1337, 1338, 1339), {1: 1, 2: 2})
    return L.seed_rollup(L.lco_report(p))


@query("m2_hybrid", "k:l source:s d:l v:d", f"{sql_base()}, {sql_classes()}, tr AS (SELECT * FROM fx_images WHERE combo <> 'c1'), {sql_protos('protos', 'tr')} SELECT k, source, d, p[d + 1] AS v FROM protos, range(64) r(d)")
def m2(spark, d):
    """The pure culture of one class is held out, so that class falls back."""
    m = P.hybrid_prototypes(tiles(spark, d), images(spark, d).where("combo <> 'c1'"), CLASSES)
    return P.prototype_table(spark, m).select("k", "source", F.posexplode("p").alias("d", "v"))


@query("m1_pure", "k:l d:l v:d", f"{sql_base()}, {sql_classes()}, tr AS (SELECT * FROM fx_images WHERE NOT contains(combo, '_')), {sql_protos('protos', 'tr')} SELECT k, d, p[d + 1] AS v FROM protos, range(64) r(d)")
def m1(spark, d):
    m = P.pure_prototypes(tiles(spark, d), images(spark, d), CLASSES)
    return P.prototype_table(spark, m).select("k", F.posexplode("p").alias("d", "v"))


_POOL3 = "[avg(v), quantile_cont(v, 0.9), max(v)]"
_NCV = f"""{sql_base()}, {sql_classes()}, {_FOLD}, ex AS (SELECT i.image_id, i.combo, i.label, f AS fold, coalesce(fd.fold = f, false) AS dev FROM fx_images i LEFT JOIN fd USING (combo), range(5) r(f)),
trn AS (SELECT * FROM ex WHERE NOT dev), {sql_protos('protos', 'trn', 'fold')}, {sql_sims('sims', 'protos', 'fold')}, {sql_sparsemax('sims', 'wts')},
ms AS (SELECT fold, image_id, 'cosine' AS rd, unnest(range(5)) AS k, unnest(s) AS v FROM wts UNION ALL SELECT fold, image_id, 'sparsemax', unnest(range(5)), unnest(w) FROM wts),
sa AS (SELECT rd, fold, image_id, k, unnest(['mean', 'q90', 'max']) AS agg, unnest({_POOL3}) AS score FROM ms GROUP BY 1, 2, 3, 4),
sc AS (SELECT rd || '/' || agg AS key, fold, image_id, k, score, combo, dev, label[k + 1] AS label FROM sa JOIN ex USING (fold, image_id)),
thr AS (SELECT key, fold, k, coalesce(quantile_cont(score, 0.05) FILTER (WHERE label = 1), max(score) + 1) AS t FROM sc WHERE NOT dev GROUP BY 1, 2, 3),
pr AS (SELECT sc.*, CASE WHEN score > t THEN 1 ELSE 0 END AS pred, key || '#' || CAST(k AS VARCHAR) AS kk FROM sc JOIN thr USING (key, fold, k) WHERE dev)"""


@query("o14_nested_cv", "key:s per_sample_f1:d macro_f1:d auroc_mean:d", f"""{_NCV}, f AS (SELECT key, image_id, CASE WHEN sum(pred + label) > 0 THEN 2.0::DOUBLE * sum(pred * label) / sum(pred + label) ELSE 1.0 END AS f1 FROM pr GROUP BY 1, 2),
    fk AS (SELECT key, k, 2.0::DOUBLE * sum(pred * label) / greatest(sum(pred + label), 1) AS f1 FROM pr GROUP BY 1, 2), {_AUC.format(k='kk', t='pr')}
    SELECT key, avg(f1) AS per_sample_f1, (SELECT avg(f1) FROM fk WHERE fk.key = f.key) AS macro_f1, (SELECT avg(auroc) FROM auc WHERE string_split(kk, '#')[1] = f.key) AS auroc_mean FROM f GROUP BY key""")
def o14(spark, d):
    """Both read-outs under all aggregations."""
    p = L.nested_cv(images(spark, d), tiles(spark, d), CLASSES)
    b = M.bundle(p, ["key"]).select("key", "per_sample_f1", "macro_f1")
    return b.join(M.mean_auroc(p, ["key"]), "key")


@query("k3_nested_cv_report", "key:s metric:s point:d lo:d hi:d resolved:b")
def k3(spark, d):
    return L.nested_cv_report(L.nested_cv(images(spark, d), tiles(spark, d), CLASSES), n_boot=2000)


@query("o14_nested_cv_fitted", "key:s per_sample_f1:d macro_f1:d auroc_mean:d")
def o14_fitted(spark, d):
    """Fitted unmixing weights, closed-form cosines and fitted channel heads of every fold, thirty epochs in one pass each."""
    p = L.nested_cv_fitted(images(spark, d, 2, 4), tiles(spark, d, 2, 4), CLASSES4, lr=2e-2, head_lr=5e-2)
    b = M.bundle(p, ["key"]).select("key", "per_sample_f1", "macro_f1")
    return b.join(M.mean_auroc(p, ["key"]), "key")


def _half(z):
    return F.transform(z, lambda x, i: F.when(i < 32, x).otherwise(F.lit(0.0).cast("float")))


def granular_units(spark, d):
    """Two unit kinds from the same vectors: the whole tile, and its first half."""
    t = tiles(spark, d)
    return t.select(F.lit("tile").alias("granularity"), "image_id", "tile_idx", "z").unionByName(
        t.select(F.lit("half").alias("granularity"), "image_id", "tile_idx", _half("z").alias("z"))
    )


@query("o14_granularities", "key:s auroc_mean:d")
def o14_granularities(spark, d):
    """The closed form for every unit kind."""
    return M.mean_auroc(L.nested_cv_granularities(images(spark, d), granular_units(spark, d), CLASSES), ["key"])


def protocol(spark, d):
    im = images(spark, d)
    split = SP.lco_split(im, SP.select_heldout(im, {1: 1, 2: 2}, 1337))
    return SP.build_protocol(split, SP.select_dev_combos(split.where("split <> 'test'"), {2: 2}, 1337))


_GRAN = f"""{sql_base()}, {sql_classes()}, {LCO}, {LCO_SPLIT}, trained AS (SELECT DISTINCT combo FROM sp WHERE split <> 'test'), {sql_heldout({2: 2}, 1337 * 7919, 'trained', 100, 'dv')},
pt AS (SELECT image_id, combo, label, CASE WHEN split = 'test' THEN 'test' WHEN combo IN (SELECT combo FROM dv WHERE role = 'heldout') THEN 'dev' ELSE split END AS role FROM sp),
trn AS (SELECT * FROM pt WHERE role = 'train'), hv AS (SELECT image_id, tile_idx, class, list_transform(z, lambda x, i: CASE WHEN i <= 32 THEN x ELSE 0.0 END) AS z FROM fx_tiles),
ht AS (SELECT image_id, tile_idx, class, {sql_unit('z')} AS z FROM hv), {sql_protos('p1', 'trn')}, {sql_protos('p2', 'trn', tile_source='ht')},
gu AS (SELECT 'tile' AS granularity, * FROM fx_tiles UNION ALL SELECT 'half', * FROM ht), gp AS (SELECT 'tile' AS granularity, k, p FROM p1 UNION ALL SELECT 'half', k, p FROM p2),
sims AS (SELECT granularity, u.image_id, u.tile_idx, list(list_inner_product(u.z, p.p) ORDER BY p.k) AS s FROM gu u JOIN gp p USING (granularity) GROUP BY 1, 2, 3), {sql_sparsemax('sims', 'wts')},
ms AS (SELECT granularity, image_id, 'cosine' AS rd, unnest(range(5)) AS k, unnest(s) AS v FROM wts UNION ALL SELECT granularity, image_id, 'sparsemax', unnest(range(5)), unnest(w) FROM wts),
sa AS (SELECT granularity, rd, image_id, k, unnest(['mean', 'q90', 'max']) AS agg, unnest({_POOL3}) AS score FROM ms GROUP BY 1, 2, 3, 4),
sc AS (SELECT granularity || '#' || rd || '/' || agg AS gk, image_id, k, score, role, label[k + 1] AS label FROM sa JOIN pt USING (image_id) WHERE role <> 'train'),
thr AS (SELECT gk, k, coalesce(quantile_cont(score, 0.05) FILTER (WHERE label = 1), max(score) + 1) AS t FROM sc WHERE role = 'val' GROUP BY 1, 2),
pr AS (SELECT sc.*, CASE WHEN score > t THEN 1 ELSE 0 END AS pred, gk || '#' || role || '#' || CAST(k AS VARCHAR) AS kk FROM sc JOIN thr USING (gk, k)), {_AUC.format(k='kk', t='pr')},
f AS (SELECT gk, role, image_id, CASE WHEN sum(pred + label) > 0 THEN 2.0::DOUBLE * sum(pred * label) / sum(pred + label) ELSE 1.0 END AS f1 FROM pr GROUP BY 1, 2, 3),
rep AS (SELECT string_split(gk, '#')[1] AS granularity, string_split(gk, '#')[2] AS key, role, avg(f1) AS per_sample_f1, (SELECT avg(auroc) FROM auc WHERE starts_with(kk, gk || '#' || role || '#')) AS auroc_mean FROM f GROUP BY gk, role)"""


@query("o8_granularity", "granularity:s key:s role:s auroc_mean:d per_sample_f1:d", f"{_GRAN} SELECT * FROM rep")
def o8(spark, d):
    return L.granularity_report(granular_units(spark, d), protocol(spark, d), CLASSES)


@query("o8_selected", "granularity:s key:s auroc_mean:d", f"{_GRAN} SELECT granularity, key, auroc_mean FROM rep WHERE role = 'dev' ORDER BY auroc_mean DESC NULLS LAST, granularity || '/' || key LIMIT 1")
def o8_selected(spark, d):
    """The granularity and read-out that the development role selects."""
    return L.select_on_dev(L.granularity_report(granular_units(spark, d), protocol(spark, d), CLASSES))


@query("o9_granularity_stage", "granularity:s variant:s key:s dev_auroc:d test_auroc:d test_f1:d test_macro_f1:d test_exact:d test_mean_predicted:d test_f1_dev:d")
def o9_stage(spark, d):
    """Both unit kinds and both variants trained together, thirty epochs of one pass each."""
    return L.granularity_stage(granular_units(spark, d), protocol(spark, d), CLASSES, ("tile", "half"), lr=2e-2)


@query("o9_granularity_closed", "granularity:s variant:s key:s dev_auroc:d test_auroc:d test_f1:d test_macro_f1:d test_exact:d test_mean_predicted:d test_f1_dev:d", f"""{_GRAN},
    cut AS (SELECT role AS ck, gk, k, coalesce(quantile_cont(score, 0.05) FILTER (WHERE label = 1), max(score) + 1) AS t FROM sc WHERE role IN ('val', 'dev') GROUP BY 1, 2, 3),
    tp AS (SELECT ck, gk, image_id, k, label, CASE WHEN score > t THEN 1 ELSE 0 END AS pred FROM sc JOIN cut USING (gk, k) WHERE role = 'test'),
    fi AS (SELECT ck, gk, image_id, CASE WHEN sum(pred + label) > 0 THEN 2.0::DOUBLE * sum(pred * label) / sum(pred + label) ELSE 1.0 END AS f1, CASE WHEN bool_and(pred = label) THEN 1.0::DOUBLE ELSE 0 END AS em, sum(pred) AS np FROM tp GROUP BY 1, 2, 3),
    fk AS (SELECT gk, k, 2.0::DOUBLE * sum(pred * label) / greatest(sum(pred + label), 1) AS f1 FROM tp WHERE ck = 'val' GROUP BY 1, 2)
    SELECT string_split(gk, '#')[1] AS granularity, 'start' AS variant, string_split(gk, '#')[2] AS key, (SELECT avg(auroc) FROM auc WHERE starts_with(kk, gk || '#dev#')) AS dev_auroc, (SELECT avg(auroc) FROM auc WHERE starts_with(kk, gk || '#test#')) AS test_auroc,
      avg(f1) FILTER (WHERE ck = 'val') AS test_f1, (SELECT avg(f1) FROM fk WHERE fk.gk = fi.gk) AS test_macro_f1, avg(em) FILTER (WHERE ck = 'val') AS test_exact, avg(np) FILTER (WHERE ck = 'val') AS test_mean_predicted, avg(f1) FILTER (WHERE ck = 'dev') AS test_f1_dev FROM fi GROUP BY gk""")
def o9_closed(spark, d):
    """The stage before its first epoch: selection, thresholds and report of the closed form."""
    return L.granularity_stage(granular_units(spark, d), protocol(spark, d), CLASSES, ("tile", "half"), {"start": 0.0}, epochs=0)


@query("o9_calibration_stage", "rule:s metric:s value:d", f"""{_COS}, rl AS (SELECT * EXCLUDE (split), CASE WHEN split = 'test' THEN 'test' WHEN image_id % 2 = 0 THEN 'val' ELSE 'dev' END AS role FROM sc),
    q AS (SELECT role || '_q05' AS rule, k, coalesce(quantile_cont(score, 0.05) FILTER (WHERE label = 1), max(score) + 1) AS t FROM rl WHERE role <> 'test' GROUP BY role, k),
    ed AS (SELECT role, k, min(score) AS lo, max(score) AS hi FROM rl WHERE role <> 'test' GROUP BY 1, 2),
    g AS (SELECT role, k, t, sum(CASE WHEN score > t THEN label ELSE 0 END) AS tp, sum(CASE WHEN score > t THEN 1 - label ELSE 0 END) AS fp, sum(CASE WHEN score > t THEN 0 ELSE label END) AS fn FROM rl JOIN (SELECT role, k, lo + i * ((hi - lo) / 198) AS t FROM ed, range(198) r(i)) USING (role, k) GROUP BY 1, 2, 3),
    th AS (SELECT rule, k, t FROM q UNION ALL SELECT role || '_f1' AS rule, k, arg_max(t, {{'a': CASE WHEN 2 * tp + fp + fn > 0 THEN round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 12) ELSE 0 END, 'b': -t}}) AS t FROM g GROUP BY role, k),
    pr AS (SELECT rule, image_id, k, label, CASE WHEN score > t THEN 1 ELSE 0 END AS pred FROM rl JOIN th USING (k) WHERE role = 'test'),
    f AS (SELECT rule, image_id, CASE WHEN sum(pred + label) > 0 THEN 2.0::DOUBLE * sum(pred * label) / sum(pred + label) ELSE 1.0 END AS f1, bool_and(pred = label) AS em, sum(pred) AS np, sum(label) AS nt FROM pr GROUP BY 1, 2),
    fk AS (SELECT rule, k, 2.0::DOUBLE * sum(pred * label) / greatest(sum(pred + label), 1) AS f1 FROM pr GROUP BY 1, 2),
    b AS (SELECT rule, avg(f1) AS per_sample_f1, (SELECT avg(f1) FROM fk WHERE fk.rule = f.rule) AS macro_f1, avg(CASE WHEN em THEN 1.0::DOUBLE ELSE 0 END) AS exact_match, avg(np) AS mean_predicted, avg(nt) AS mean_true FROM f GROUP BY rule)
    SELECT rule, metric, value FROM b UNPIVOT (value FOR metric IN (per_sample_f1, macro_f1, exact_match, mean_predicted, mean_true))""")
def o9(spark, d):
    im, t = split_images(spark, d), tiles(spark, d)
    m = P.hybrid_prototypes(t, im.where("split = 'train'"), CLASSES)
    s = D.image_scores(t, im, m)
    role = F.when(F.col("split") == "test", "test").when(F.col("image_id") % 2 == 0, "val").otherwise("dev")
    return L.calibration_stage(s.withColumn("role", role))


# ---- open set --------------------------------------------------------------------

_FOLDS = f"""{sql_base()}, {sql_classes()}, {_SPL}, ptr AS (SELECT * FROM trn WHERE NOT contains(combo, '_')), {sql_protos('protos', 'ptr')},
pf AS (SELECT ks AS k_star, k, p FROM protos, range(5) r(ks) WHERE k <> ks), {sql_sims('sims', 'pf', 'k_star')}, {sql_sparsemax('sims', 'wts')}, pm AS (SELECT k_star, list(p ORDER BY k) AS pm FROM pf GROUP BY 1),
res AS (SELECT w.*, list_transform(range(1, 65), lambda d: z[d] - list_sum(list_transform(range(1, 5), lambda k: w[k] * pm[k][d]))) AS r FROM wts w JOIN pm USING (k_star)),
resn AS (SELECT *, sqrt(list_inner_product(r, r)) AS residual, -list_max(s) AS neg_max FROM res)"""
_KNN = """pool AS (SELECT t.z, trn.label FROM fx_tiles t JOIN trn USING (image_id)), qt AS (SELECT t.image_id, t.tile_idx, t.z FROM fx_tiles t JOIN spl USING (image_id) WHERE split = 'test'),
pairs AS (SELECT image_id, tile_idx, label, list_inner_product(qt.z, pool.z) AS c FROM qt, pool),
kn AS (SELECT ks AS k_star, image_id, tile_idx, 1.0 - list_sort(list(c), 'DESC')[10] AS knn FROM pairs, range(5) r(ks) WHERE label[ks + 1] = 0 GROUP BY 1, 2, 3)"""


def _osr(entries: str) -> str:
    return f"""oi AS ({entries}), os AS (SELECT oi.k_star, oi.key, oi.k_star || '#' || oi.key AS kk, oi.score, spl.label[oi.k_star + 1] AS label FROM oi JOIN spl USING (image_id) WHERE split = 'test'),
    {_AUC.format(k='kk', t='os')}, {_ROC.format(k='kk', t='os')}
    SELECT CAST(string_split(kk, '#')[1] AS BIGINT) AS k_star, string_split(kk, '#')[2] AS key, auroc, aupr, (SELECT coalesce(min(fp / nullif(nt, 0)) FILTER (WHERE tp / nullif(pt, 0) >= 0.95::DOUBLE), 1.0) FROM roc WHERE roc.kk = auc.kk) AS fpr95 FROM auc JOIN ap USING (kk)"""


_RES_NEG = "SELECT k_star, image_id, 'residual' AS key, avg(residual) AS score FROM resn GROUP BY 1, 2 UNION ALL SELECT k_star, image_id, 'neg_max', avg(neg_max) FROM resn GROUP BY 1, 2"
_ENERGY = "SELECT k_star, image_id, 'energy@{t}', avg(-(list_max(s) + {t} * ln(list_sum(list_transform(s, lambda x: exp((x - list_max(s)) / {t})))))) FROM resn GROUP BY 1, 2"


@query("o10_openset", "k_star:l key:s auroc:d aupr:d fpr95:d", f"{_FOLDS}, {_osr(_RES_NEG)}")
def o10(spark, d):
    return O.openset_loso(split_images(spark, d), tiles(spark, d), CLASSES)


@query("o11_openset_sweep", "k_star:l key:s auroc:d aupr:d fpr95:d", f"{_FOLDS}, {_KNN}, " + _osr(f"{_RES_NEG} UNION ALL {_ENERGY.format(t=0.1)} UNION ALL {_ENERGY.format(t=1.0)} UNION ALL SELECT k_star, image_id, 'knn', avg(knn) FROM kn GROUP BY 1, 2"))
def o11(spark, d):
    return O.openset_sweep(split_images(spark, d), tiles(spark, d), CLASSES)


@query("o11_fold_summary", "key:s metric:s mean:d std:d n:l", f"SELECT key, metric, avg(value) AS mean, stddev_pop(value) AS std, count(value) AS n FROM ({_FOLDS}, {_osr(_RES_NEG)}) UNPIVOT (value FOR metric IN (auroc, aupr, fpr95)) GROUP BY 1, 2")
def o11s(spark, d):
    return O.fold_summary(O.openset_loso(split_images(spark, d), tiles(spark, d), CLASSES))


@query("o11_knn_tpr_sweep", "k_star:l target:d fpr:d", f"""{sql_base()}, {_SPL}, {_KNN}, os AS (SELECT k_star, avg(knn) AS score, any_value(spl.label[k_star + 1]) AS label FROM kn JOIN spl USING (image_id) GROUP BY k_star, image_id), {_ROC.format(k='k_star', t='os')}
    SELECT k_star, target, CASE WHEN max(nt) > 0 THEN coalesce(min(fp / nullif(nt, 0)) FILTER (WHERE tp / nullif(pt, 0) >= target), 1.0) END AS fpr FROM roc, (VALUES (0.8::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE)) v(target) GROUP BY 1, 2""")
def o11k(spark, d):
    return O.knn_tpr_sweep(split_images(spark, d), tiles(spark, d), CLASSES)


def _knn_queries(spark, d, **kw):
    from tessella.operators.knn import knn_distance

    im, t = split_images(spark, d), tiles(spark, d)
    test = t.join(im.where("split = 'test'").select("image_id"), "image_id", "left_semi")
    pool = t.join(im.where("split = 'train'").select("image_id", "label"), "image_id")
    return knn_distance(test, pool, 10, ("image_id", "tile_idx"), [[k] for k in range(5)], **kw).withColumnRenamed("fold", "k_star")


_KNN_SQL = f"{sql_base()}, {_SPL}, {_KNN} SELECT k_star, image_id, tile_idx, knn FROM kn"


@query("c7_knn", "k_star:l image_id:l tile_idx:l knn:d", _KNN_SQL)
def c7(spark, d):
    return _knn_queries(spark, d)


@query("c7_knn_blocks", "k_star:l image_id:l tile_idx:l knn:d", _KNN_SQL)
def c7_blocks(spark, d):
    """The block grid used for pools too large to send to every task."""
    return _knn_queries(spark, d, send_limit=0, block_rows=64)


_VAR = "list_transform(['residual', 'neg_max', 'energy', 'knn', 'residual_norm', 'knn_norm'], lambda x: x)"


@query("o12_openworld", "stage:s k_star:l k_in:l variant:s auroc:d aupr:d fpr95:d")
def o12(spark, d):
    """Six scores under three aggregations, outer folds on test and inner folds on val."""
    return O.openworld_variants(split_images(spark, d), tiles(spark, d), CLASSES)


@query("o12_outer_norm", "k_star:l variant:s auroc:d", f"""{_FOLDS}, {_KNN.replace("WHERE split = 'test'", "WHERE split <> 'train'")},
    u AS (SELECT resn.*, knn, list_position(s, list_max(s)) - 1 AS j FROM resn JOIN kn USING (k_star, image_id, tile_idx)), ub AS (SELECT *, CASE WHEN j >= k_star THEN j + 1 ELSE j END AS best FROM u),
    ref AS (SELECT k_star, CAST(combo[2:] AS BIGINT) AS best, greatest(quantile_disc(residual, 0.5), 1e-6) AS rr, greatest(quantile_disc(knn, 0.5), 1e-6) AS rk FROM ub JOIN spl USING (image_id) WHERE split = 'val' AND NOT contains(combo, '_') AND combo <> 'c' || CAST(k_star AS VARCHAR) GROUP BY 1, 2),
    nm AS (SELECT ub.k_star, ub.image_id, residual / coalesce(rr, 1.0) AS rn, knn / coalesce(rk, 1.0) AS kn FROM ub LEFT JOIN ref USING (k_star, best)),
    oi AS (SELECT k_star, image_id, unnest(['residual_norm/mean', 'residual_norm/q90', 'residual_norm/max', 'knn_norm/mean', 'knn_norm/q90', 'knn_norm/max']) AS key, unnest([avg(rn), quantile_cont(rn, 0.9), max(rn), avg(kn), quantile_cont(kn, 0.9), max(kn)]) AS score FROM nm GROUP BY 1, 2),
    os AS (SELECT oi.k_star || '#' || oi.key AS kk, oi.score, spl.label[oi.k_star + 1] AS label FROM oi JOIN spl USING (image_id) WHERE split = 'test'), {_AUC.format(k='kk', t='os')}
    SELECT CAST(string_split(kk, '#')[1] AS BIGINT) AS k_star, string_split(kk, '#')[2] AS variant, auroc FROM auc""")
def o12_outer(spark, d):
    v = O.openworld_variants(split_images(spark, d), tiles(spark, d), CLASSES, inner=False)
    return v.where(F.col("variant").contains("_norm"))


# ---- discovery -------------------------------------------------------------------

_GATES = (0.15, 0.93)
_DISC = f"""{_FOLDS}, gt AS (SELECT i AS g, [0.15::DOUBLE, 0.93][i + 1] AS t FROM range(2) r(i)),
fl AS (SELECT k_star, g, z FROM resn JOIN spl USING (image_id), gt WHERE split = 'test' AND residual > t),
nf AS (SELECT k_star, g, count(*) AS n FROM fl GROUP BY 1, 2), mv AS (SELECT k_star, g, d, avg(z[d]) AS m FROM fl, range(1, 65) r(d) GROUP BY 1, 2, 3),
nv AS (SELECT k_star, g, list(m ORDER BY d) AS v FROM mv JOIN nf USING (k_star, g) WHERE n >= 5 GROUP BY 1, 2), np AS (SELECT k_star, g, {sql_unit('v')} AS p FROM nv),
ap2 AS (SELECT k_star, g, k, p FROM pf, gt UNION ALL SELECT k_star, g, 9 AS k, p FROM np),
ti AS (SELECT t.image_id, t.tile_idx, t.z, a.k_star, a.g, list(list_inner_product(t.z, a.p) ORDER BY a.k) AS s FROM fx_tiles t, ap2 a GROUP BY ALL),
ia AS (SELECT k_star, g, image_id, j, avg(v) AS m FROM (SELECT k_star, g, image_id, unnest(range(len(s))) AS j, unnest(s) AS v FROM ti) GROUP BY 1, 2, 3, 4),
bs AS (SELECT k_star, g, image_id, arg_max(j, {{'a': m, 'b': -j}}) AS best FROM ia GROUP BY 1, 2, 3),
hl AS (SELECT bs.* FROM bs JOIN spl USING (image_id) WHERE split = 'test' AND label[k_star + 1] = 1),
di AS (SELECT k_star, g, avg(CASE WHEN best >= 4 THEN 1.0::DOUBLE ELSE 0 END) AS recall, CASE WHEN count(*) FILTER (WHERE best >= 4) > 0 THEN 1.0 END AS purity, count(*) FILTER (WHERE best >= 4)::DOUBLE / count(*) AS cluster_accuracy FROM hl GROUP BY 1, 2)"""


@query("j12_discovery", "k_star:l gate:d n_flagged:l recall:d purity:d cluster_accuracy:d", f"{_DISC} SELECT k_star, t AS gate, coalesce(n, 0) AS n_flagged, recall, purity, cluster_accuracy FROM di JOIN gt USING (g) LEFT JOIN nf USING (k_star, g)")
def j12(spark, d):
    return O.discover_loso(split_images(spark, d), tiles(spark, d), CLASSES, _GATES)


_KL = "list_transform(list_filter(list_zip(range(5), label), lambda e: e[1] <> k_star), lambda e: e[2])"
_DRIFT = f"""{_DISC}, kw AS (SELECT k_star, image_id, j, avg(v) AS w FROM (SELECT k_star, image_id, unnest(range(4)) AS j, unnest(w) AS v FROM wts) GROUP BY 1, 2, 3),
kl AS (SELECT kw.*, split, label[k_star + 1] AS held, {_KL}[j + 1] AS y FROM kw JOIN spl USING (image_id)),
th AS (SELECT k_star, j, coalesce(quantile_cont(w, 0.05) FILTER (WHERE y = 1), 0.5) AS t FROM kl WHERE split = 'train' AND held = 0 GROUP BY 1, 2),
f0 AS (SELECT k_star, image_id, CASE WHEN sum(y + CASE WHEN w > t THEN 1 ELSE 0 END) > 0 THEN 2.0::DOUBLE * sum(CASE WHEN w > t THEN y ELSE 0 END) / sum(y + CASE WHEN w > t THEN 1 ELSE 0 END) ELSE 1.0 END AS f1 FROM kl JOIN th USING (k_star, j) WHERE split = 'test' GROUP BY 1, 2),
tj AS (SELECT ti.* FROM ti JOIN spl USING (image_id) WHERE split = 'test'), {sql_sparsemax('tj', 'w2')},
kv AS (SELECT k_star, g, image_id, j, avg(v) AS w FROM (SELECT k_star, g, image_id, unnest(range(4)) AS j, unnest(w[1:4]) AS v FROM w2) GROUP BY 1, 2, 3, 4),
kx AS (SELECT kv.*, {_KL}[j + 1] AS y FROM kv JOIN spl USING (image_id)),
f2 AS (SELECT k_star, g, image_id, CASE WHEN sum(y + CASE WHEN w > t THEN 1 ELSE 0 END) > 0 THEN 2.0::DOUBLE * sum(CASE WHEN w > t THEN y ELSE 0 END) / sum(y + CASE WHEN w > t THEN 1 ELSE 0 END) ELSE 1.0 END AS f1 FROM kx JOIN th USING (k_star, j) GROUP BY 1, 2, 3)"""


@query("j13_drift", "k_star:l gate:d f1_before:d f1_after:d drift:d", f"""{_DRIFT}, a AS (SELECT k_star, g, avg(f1) AS f1_after FROM f2 GROUP BY 1, 2), b AS (SELECT k_star, avg(f1) AS f1_before FROM f0 GROUP BY 1)
    SELECT k_star, t AS gate, f1_before, f1_after, f1_after - f1_before AS drift FROM a JOIN b USING (k_star) JOIN gt USING (g)""")
def j13(spark, d):
    return O.discover_loso(split_images(spark, d), tiles(spark, d), CLASSES, _GATES)


@query("o13_discover_sinkhorn", "k_star:l gate:d recall:d cluster_accuracy:d")
def o13(spark, d):
    """Two balanced clusters per fold (iterative)."""
    return O.discover_loso(split_images(spark, d), tiles(spark, d), CLASSES[:5], (0.15,), k_new=2, seed=7)


_FOUND = "k_star:l gate:d n_flagged:l recall:d purity:d cluster_accuracy:d f1_before:d f1_after:d drift:d"


def _refined(spark, d, method):
    """Two balanced clusters a fold and gate, refined for all folds and gates together at full steps."""
    return O.discover_loso(split_images(spark, d), tiles(spark, d), CLASSES, _GATES, k_new=2, refine=method, seed=7)


@query("o13_discover_uno", _FOUND)
def o13_uno(spark, d):
    return _refined(spark, d, "uno")


@query("o13_discover_simgcd", _FOUND)
def o13_simgcd(spark, d):
    return _refined(spark, d, "simgcd")


@query("o13_discover_kd", _FOUND)
def o13_kd(spark, d):
    return _refined(spark, d, "kd")


_UNITS = _KNN.replace("WHERE split = 'test'", "WHERE split <> 'train'")
_NORM = f"""{_FOLDS}, {_UNITS}, u AS (SELECT resn.*, knn, list_position(s, list_max(s)) - 1 AS j FROM resn JOIN kn USING (k_star, image_id, tile_idx)), ub AS (SELECT *, CASE WHEN j >= k_star THEN j + 1 ELSE j END AS best FROM u),
ref AS (SELECT k_star, CAST(combo[2:] AS BIGINT) AS best, greatest(quantile_disc(residual, 0.5), 1e-6) AS rr, greatest(quantile_disc(knn, 0.5), 1e-6) AS rk FROM ub JOIN spl USING (image_id) WHERE split = 'val' AND NOT contains(combo, '_') AND combo <> 'c' || CAST(k_star AS VARCHAR) GROUP BY 1, 2),
nm AS (SELECT ub.k_star, ub.image_id, ub.tile_idx, residual, knn, residual / coalesce(rr, 1.0) AS rn, knn / coalesce(rk, 1.0) AS kn FROM ub LEFT JOIN ref USING (k_star, best)),
gts AS (SELECT k_star, unnest(['residual_abs0.15', 'residual_q95', 'residual_norm_q95', 'knn_q95', 'knn_norm_q95']) AS gate, unnest([0.15, quantile_cont(residual, 0.95), quantile_cont(rn, 0.95), quantile_cont(knn, 0.95), quantile_cont(kn, 0.95)]) AS threshold FROM nm JOIN spl USING (image_id) WHERE split = 'val' AND label[k_star + 1] = 0 GROUP BY 1)"""


@query("i10_gates", "k_star:l gate:s threshold:d", f"{_NORM} SELECT * FROM gts")
def i10(spark, d):
    im, t = split_images(spark, d), tiles(spark, d)
    excludes = [[k] for k in range(5)]
    train, val = im.where("split = 'train'"), im.where("split = 'val'")
    models = O.fold_models(t, train, CLASSES, excludes)
    pool = t.join(train.select("image_id", "label"), "image_id")
    vs = O.unit_unknown_scores(t.join(val.select("image_id"), "image_id", "left_semi"), models, pool, excludes, 10, 0.1)
    n = O.with_normalised(vs, O.class_refs(vs, val, CLASSES, models)).join(val.select("image_id", "label"), "image_id")
    return O.discovery_gates(n.where(F.element_at("label", F.col("fold") + 1) == 0)).withColumnRenamed("fold", "k_star")


@query("o12_discovery_flags", "k_star:l gate:s n_flagged:l", f"""{_NORM} SELECT k_star, gate, count(*) FILTER (WHERE CASE gate WHEN 'residual_norm_q95' THEN rn WHEN 'knn_q95' THEN knn WHEN 'knn_norm_q95' THEN kn ELSE residual END > threshold) AS n_flagged
    FROM nm JOIN spl USING (image_id) JOIN gts USING (k_star) WHERE split = 'test' GROUP BY 1, 2""")
def o12_flags(spark, d):
    """Flagged units under the calibrated gates, with the whole discovery report behind them."""
    return O.openworld_discovery(split_images(spark, d), tiles(spark, d), CLASSES)
