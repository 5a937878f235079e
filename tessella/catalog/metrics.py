"""Calibration, metric and interval queries."""

from pyspark.sql import functions as F

from tessella.catalog.aggregates import PER_CLASS, PER_IMAGE, PRED, predictions
from tessella.catalog.fixtures import CLASSES, images, sql_base, table, tiles
from tessella.catalog.registry import query
from tessella.catalog.splits import _FOLD
from tessella.catalog.vectors import MEAN, image_scores
from tessella.operators import calibrate as C
from tessella.operators import intervals as I
from tessella.operators import metrics as M
from tessella.operators import splits as S
from tessella.operators.isotonic import isotonic, isotonic_blocks

# a scalar score with a binary label: document length against its two flags
_DL = "WITH dl AS (SELECT d.doc_id AS image_id, lang, CAST(n_chars AS DOUBLE) AS score, quality AS label FROM documents d JOIN labels USING (doc_id))"


def doc_scores(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    j = docs.join(table(spark, d, "labels"), "doc_id")
    return j.select(F.col("doc_id").alias("image_id"), "lang", F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("label"))


_EL = "WITH el AS (SELECT event_id AS image_id, event_type AS lang, round(value) AS score, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS label FROM events)"


def event_scores(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("image_id"), F.col("event_type").alias("lang"), F.round("value").alias("score"), (F.col("user_id") % 3 == 0).cast("int").alias("label"))


# ---- calibration -----------------------------------------------------------------


@query("i1_quantile_thr", "k:l threshold:d", f"{MEAN} SELECT k, quantile_cont(score, 0.05) AS threshold FROM sc WHERE label = 1 GROUP BY 1")
def i1(spark, d):
    return C.quantile_thresholds(image_scores(spark, d), 0.05)


_NOC2 = "ns AS (SELECT * FROM sc WHERE image_id NOT IN (SELECT image_id FROM sc WHERE k = 2 AND label = 1))"


@query("i1_quantile_fallbacks", "k:l unmix:d matching:d never:d", f"""{MEAN}, {_NOC2} SELECT k, coalesce(quantile_cont(score, 0.05) FILTER (WHERE label = 1), 0.05) AS unmix,
    coalesce(quantile_cont(score, 0.05) FILTER (WHERE label = 1), 0.5) AS matching, coalesce(quantile_cont(score, 0.05) FILTER (WHERE label = 1), max(score) + 1) AS never FROM ns GROUP BY 1""")
def i1_fallbacks(spark, d):
    """Calibration without any positive of one class, under the three fallbacks."""
    s = image_scores(spark, d).where(F.col("label")[2] == 0)
    out = None
    for name, fb in (("unmix", C.FALLBACK_UNMIX), ("matching", C.FALLBACK_MATCH), ("never", C.NEVER_FIRES)):
        t = C.quantile_thresholds(s, 0.05, fb).withColumnRenamed("threshold", name)
        out = t if out is None else out.join(t, "k")
    return out


@query("i2_unknown_threshold", "unknown_threshold:d", f"{MEAN}, mx AS (SELECT image_id, max(score) AS m FROM sc GROUP BY 1) SELECT quantile_cont(m, 0.05) AS unknown_threshold FROM mx")
def i2(spark, d):
    s = image_scores(spark, d).withColumn("m", F.array_max("scores"))
    return C.unknown_threshold(s, "m", 0.05)


# scores squeezed into (0, 1) so the fixed grid separates them
_SQ = "sq AS (SELECT *, 1.0 / (1.0 + exp(-8.0 * score)) AS p FROM sc)"
_GRID = """g AS (SELECT k, t, sum(CASE WHEN p > t THEN label ELSE 0 END) AS tp, sum(CASE WHEN p > t THEN 1 - label ELSE 0 END) AS fp, sum(CASE WHEN p > t THEN 0 ELSE label END) AS fn FROM sq, grid GROUP BY 1, 2),
gf AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM g)"""
_FIXED = "grid AS (SELECT 0.01 + i * ((0.99 - 0.01)::DOUBLE / 98) AS t FROM range(99) r(i))"


def squeezed(spark, d):
    return image_scores(spark, d).withColumn("scores", F.transform("scores", lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(x * -8.0))))


@query("i3_argmax_f1", "k:l threshold:d f1:d", f"{MEAN}, {_SQ}, {_FIXED}, {_GRID} SELECT k, arg_max(t, {{'a': round(f1, 12), 'b': -t}}) AS threshold, max(f1) AS f1 FROM gf GROUP BY 1")
def i3(spark, d):
    return C.argmax_f1_thresholds(squeezed(spark, d))


@query("c5_score_grid", "k:l g:l tp:l fp:l fn:l", f"{MEAN}, {_SQ}, {_FIXED}, {_GRID} SELECT k, round((t - 0.01) * 100) AS g, tp, fp, fn FROM gf")
def c5(spark, d):
    return C.score_grid(squeezed(spark, d))


_MINMAX = """ed AS (SELECT k, min(score) AS lo, max(score) AS hi FROM sc GROUP BY 1), sq AS (SELECT *, score AS p FROM sc),
g AS (SELECT k, t, sum(CASE WHEN p > t THEN label ELSE 0 END) AS tp, sum(CASE WHEN p > t THEN 1 - label ELSE 0 END) AS fp, sum(CASE WHEN p > t THEN 0 ELSE label END) AS fn
  FROM sq JOIN (SELECT k, lo + i * ((hi - lo) / 198) AS t FROM ed, range(198) r(i)) USING (k) GROUP BY 1, 2),
gf AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM g)"""


@query("i4_argmax_f1_minmax", "k:l threshold:d f1:d", f"{MEAN}, {_MINMAX} SELECT k, arg_max(t, {{'a': round(f1, 12), 'b': -t}}) AS threshold, max(f1) AS f1 FROM gf GROUP BY 1")
def i4(spark, d):
    return C.argmax_f1_thresholds(image_scores(spark, d), "minmax")


@query("i5_argmax_f1_probe", "k:l threshold:d f1:d", f"{MEAN}, {_NOC2}, sq AS (SELECT *, 1.0 / (1.0 + exp(-8.0 * score)) AS p FROM ns), {_FIXED}, {_GRID} SELECT k, arg_max(t, {{'a': round(f1, 12), 'b': -t}}) AS threshold, max(f1) AS f1 FROM gf WHERE NOT (tp + fp = 0 AND tp + fn > 0) GROUP BY 1")
def i5(spark, d):
    return C.argmax_f1_thresholds(squeezed(spark, d).where(F.col("label")[2] == 0), skip_empty=True)


def _isotonic(src: str, by: str) -> str:
    """Isotonic fit of (by, score, label) by the max-min formula: it_fit(by, score, n, y, value)."""
    return f"""it_p AS (SELECT {by}, score, count(*) AS n, sum(label) AS y FROM {src} GROUP BY 1, 2),
it_c AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(y) OVER w AS cy FROM it_p WINDOW w AS (PARTITION BY {by} ORDER BY score)),
it_m AS (SELECT a.{by}, a.i AS a, b.i, CAST(b.cy - a.cy + a.y AS DOUBLE) / CAST(b.cn - a.cn + a.n AS DOUBLE) AS m FROM it_c a JOIN it_c b ON a.{by} = b.{by} AND b.i >= a.i),
it_n AS (SELECT {by}, i, min(m) OVER (PARTITION BY {by}, a ORDER BY i DESC) AS m FROM it_m),
it_v AS (SELECT {by}, i, max(m) AS value FROM it_n GROUP BY 1, 2),
it_fit AS (SELECT {by}, score, n, y, value FROM it_c JOIN it_v USING ({by}, i))"""


def _pairs_auroc(src: str, name: str) -> str:
    return f"{name} AS (SELECT p.k, avg(CASE WHEN p.score > q.score THEN 1.0::DOUBLE WHEN p.score = q.score THEN 0.5 ELSE 0 END) AS auroc FROM {src} p JOIN {src} q ON p.k = q.k AND p.label = 1 AND q.label = 0 GROUP BY 1)"


@query("i6_isotonic_auroc", "k:l auroc_before:d auroc_after:d", f"""{MEAN}, {_isotonic('sc', 'k')}, af AS (SELECT sc.k, sc.label, it_fit.value AS score FROM sc JOIN it_fit USING (k, score)), {_pairs_auroc('sc', 'ba')}, {_pairs_auroc('af', 'aa')}
    SELECT k, ba.auroc AS auroc_before, aa.auroc AS auroc_after FROM ba JOIN aa USING (k)""")
def i6(spark, d):
    """Pools create ties, so the AUROC after recalibration may move slightly."""
    s = image_scores(spark, d).select("image_id", "label", "scores")
    after = M.class_auroc(isotonic(s, s, CLASSES)).withColumnRenamed("auroc", "auroc_after")
    return M.class_auroc(s).withColumnRenamed("auroc", "auroc_before").join(after, "k")


@query("i6_isotonic_blocks", "lang:s lo:d hi:d n:l y:l value:d", f"{_EL}, {_isotonic('el', 'lang')} SELECT lang, min(score) AS lo, max(score) AS hi, sum(n) AS n, sum(y) AS y, value FROM it_fit GROUP BY lang, value")
def i6_blocks(spark, d):
    """The fitted steps of every event's rounded value against its flag, by type."""
    points = event_scores(spark, d).select("lang", F.col("score").alias("x"), F.col("label").alias("y"))
    return isotonic_blocks(points, ["lang"]).withColumn("value", F.col("y") / F.col("n"))


@query("i7_calibration_grid", "rule:s k:l threshold:d", f"""{MEAN}, rl AS (SELECT *, CASE WHEN image_id % 2 = 0 THEN 'val' ELSE 'dev' END AS role FROM sc),
    q AS (SELECT role || '_q05' AS rule, k, coalesce(quantile_cont(score, 0.05) FILTER (WHERE label = 1), max(score) + 1) AS threshold FROM rl GROUP BY role, k),
    ed AS (SELECT role, k, min(score) AS lo, max(score) AS hi FROM rl GROUP BY 1, 2),
    g AS (SELECT role, k, t, sum(CASE WHEN score > t THEN label ELSE 0 END) AS tp, sum(CASE WHEN score > t THEN 1 - label ELSE 0 END) AS fp, sum(CASE WHEN score > t THEN 0 ELSE label END) AS fn FROM rl JOIN (SELECT role, k, lo + i * ((hi - lo) / 198) AS t FROM ed, range(198) r(i)) USING (role, k) GROUP BY 1, 2, 3),
    gf AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 12) ELSE 0.0 END AS f1 FROM g)
    SELECT * FROM q UNION ALL SELECT role || '_f1' AS rule, k, arg_max(t, {{'a': f1, 'b': -t}}) AS threshold FROM gf GROUP BY role, k""")
def i7(spark, d):
    s = image_scores(spark, d).withColumn("role", F.when(F.col("image_id") % 2 == 0, "val").otherwise("dev"))
    return C.calibration_grid(s)


@query("i8_quantile_sweep", "q:d k:l threshold:d", f"{MEAN} SELECT q, k, quantile_cont(score, [0.01, 0.05, 0.1, 0.2])[i] AS threshold FROM sc, (VALUES (1, 0.01), (2, 0.05), (3, 0.1), (4, 0.2)) v(i, q) WHERE label = 1 GROUP BY q, i, k")
def i8(spark, d):
    return C.quantile_thresholds(image_scores(spark, d), [0.01, 0.05, 0.1, 0.2])


@query("i9_fold_thresholds", "image_id:l fold:l k:l pred:l", f"""{MEAN}, {_FOLD}, e AS (SELECT sc.*, f AS fold, CASE WHEN fd.fold = f THEN 'dev' ELSE 'train' END AS role FROM sc LEFT JOIN fd USING (combo), range(5) r(f)),
    th AS (SELECT fold, k, coalesce(quantile_cont(score, 0.05) FILTER (WHERE label = 1), max(score) + 1) AS t FROM e WHERE role = 'train' GROUP BY 1, 2)
    SELECT image_id, fold, k, CASE WHEN score > t THEN 1 ELSE 0 END AS pred FROM e JOIN th USING (fold, k) WHERE role = 'dev'""".replace("SELECT sc.*, f AS fold, CASE", "SELECT sc.image_id, sc.k, sc.score, sc.label, f AS fold, CASE"))
def i9(spark, d):
    """Thresholds from each fold's training rows, applied to its development rows, pooled."""
    s = image_scores(spark, d)
    e = S.expand_folds(s, S.build_folds(images(spark, d), 5, 1337), 5)
    thr = C.quantile_thresholds(e.where("role = 'train'"), 0.05, C.NEVER_FIRES, ["fold"])
    p = C.apply_thresholds(e.where("role = 'dev'"), thr, ["fold"])
    return p.select("image_id", "fold", F.posexplode("pred").alias("k", "pred"))


# ---- classification metrics ------------------------------------------------------


@query("j1_sample_f1", "per_sample_f1:d", f"{PRED}, {PER_IMAGE} SELECT avg(f1) AS per_sample_f1 FROM f")
def j1(spark, d):
    return M.per_sample_f1(predictions(spark, d))


@query("j2_macro_f1", "macro_f1:d", f"{PRED}, {PER_CLASS} SELECT avg(f1) AS macro_f1 FROM fk")
def j2(spark, d):
    return M.macro_f1(predictions(spark, d))


@query("j2_class_f1", "k:l f1:d", f"{PRED}, {PER_CLASS} SELECT k, f1 FROM fk")
def j2k(spark, d):
    return M.class_f1(predictions(spark, d))


@query("j3_exact", "exact_match:d", f"{PRED}, {PER_IMAGE} SELECT avg(CASE WHEN em THEN 1.0::DOUBLE ELSE 0 END) AS exact_match FROM f")
def j3(spark, d):
    return M.exact_match(predictions(spark, d))


@query("j7_constant", "per_sample_f1:d macro_f1:d exact_match:d auroc_mean:d", f"{MEAN}, pr AS (SELECT *, 1 AS pred FROM sc), {PER_IMAGE}, {PER_CLASS} SELECT (SELECT avg(f1) FROM f) AS per_sample_f1, (SELECT avg(f1) FROM fk) AS macro_f1, (SELECT avg(CASE WHEN em THEN 1.0::DOUBLE ELSE 0 END) FROM f) AS exact_match, 0.5 AS auroc_mean")
def j7(spark, d):
    return M.constant_predictor(images(spark, d))


@query("j7_margins", "f1_margin:d macro_margin:d", f"{PRED}, {PER_IMAGE}, {PER_CLASS} SELECT avg(f1) - avg(2.0::DOUBLE * nt / (5 + nt)) AS f1_margin, (SELECT avg(f1 - 2.0::DOUBLE * (tp + fn) / (2 * (tp + fn) + fp + tn)) FROM fk) AS macro_margin FROM f")
def j7m(spark, d):
    return M.margins(predictions(spark, d))


@query("j8_per_combo", "combo:s n:l per_sample_f1:d exact_match:d", f"{PRED}, {PER_IMAGE} SELECT combo, count(*) AS n, avg(f1) AS per_sample_f1, avg(CASE WHEN em THEN 1.0::DOUBLE ELSE 0 END) AS exact_match FROM f GROUP BY 1")
def j8(spark, d):
    return M.per_combo(predictions(spark, d))


@query("j9_delta_f1", "f1_in:d f1_out:d delta_f1:d", f"{PRED}, {PER_IMAGE} SELECT avg(f1) FILTER (WHERE image_id % 3 <> 0) AS f1_in, avg(f1) FILTER (WHERE image_id % 3 = 0) AS f1_out, avg(f1) FILTER (WHERE image_id % 3 <> 0) - avg(f1) FILTER (WHERE image_id % 3 = 0) AS delta_f1 FROM f")
def j9(spark, d):
    return M.delta_f1(predictions(spark, d).withColumn("split", F.when(F.col("image_id") % 3 == 0, "test").otherwise("val")))


@query("j10_bundle", "ord:l per_sample_f1:d macro_f1:d exact_match:d mean_predicted:d mean_true:d", f"""{PRED}, {PER_IMAGE}, po AS (SELECT *, len(string_split(combo, '_')) AS o FROM pr),
    k AS (SELECT o, k, CASE WHEN sum(pred + label) > 0 THEN 2.0::DOUBLE * sum(pred * label) / sum(pred + label) ELSE 0.0 END AS f1 FROM po GROUP BY 1, 2), m AS (SELECT o, avg(f1) AS macro_f1 FROM k GROUP BY 1)
    SELECT o AS ord, avg(f1) AS per_sample_f1, any_value(macro_f1) AS macro_f1, avg(CASE WHEN em THEN 1.0::DOUBLE ELSE 0 END) AS exact_match, avg(np) AS mean_predicted, avg(nt) AS mean_true FROM (SELECT *, len(string_split(combo, '_')) AS o FROM f) JOIN m USING (o) GROUP BY 1""")
def j10(spark, d):
    p = predictions(spark, d).withColumn("ord", F.size(F.split("combo", "_")))
    return M.bundle(p, ["ord"])


# ---- rank metrics ----------------------------------------------------------------

_AUC = """rk AS (SELECT {k}, label, rank() OVER (PARTITION BY {k} ORDER BY score) + (count(*) OVER (PARTITION BY {k}, score) - 1) / 2.0::DOUBLE AS r FROM {t}),
auc AS (SELECT {k}, CASE WHEN sum(label) > 0 AND sum(1 - label) > 0 THEN (sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label)::DOUBLE * sum(1 - label)) END AS auroc FROM rk GROUP BY {k})"""
_ROC = """d AS (SELECT {k}, score, sum(label) AS p, sum(1 - label) AS n FROM {t} GROUP BY {k}, score),
roc AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY {k}) AS pt, sum(n) OVER (PARTITION BY {k}) AS nt FROM d WINDOW w AS (PARTITION BY {k} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT {k}, sum(p * (tp / (tp + fp))) / nullif(max(pt), 0) AS aupr FROM roc GROUP BY {k})"""


@query("j4_auroc", "k:l auroc:d", f"{MEAN}, {_AUC.format(k='k', t='sc')} SELECT * FROM auc")
def j4(spark, d):
    return M.class_auroc(image_scores(spark, d))


@query("j4_auroc_documents", "lang:s auroc:d", f"{_DL}, {_AUC.format(k='lang', t='dl')} SELECT * FROM auc")
def j4d(spark, d):
    return M.auroc(doc_scores(spark, d), ["lang"])


@query("j4_auroc_ties", "lang:s auroc:d", f"{_EL}, {_AUC.format(k='lang', t='el')} SELECT * FROM auc")
def j4t(spark, d):
    """Rounded scores: few distinct values hold all rows."""
    return M.auroc(event_scores(spark, d), ["lang"])


@query("j4_mean_auroc", "auroc_mean:d", f"{MEAN}, {_AUC.format(k='k', t='sc')} SELECT avg(auroc) AS auroc_mean FROM auc")
def j4m(spark, d):
    return M.mean_auroc(image_scores(spark, d))


@query("e4_roc_points", "lang:s score:d tp:l fp:l", f"{_DL}, {_ROC.format(k='lang', t='dl')} SELECT lang, score, tp, fp FROM roc")
def e4(spark, d):
    return M.roc_points(doc_scores(spark, d), ["lang"])


@query("j5_ap", "lang:s aupr:d", f"{_DL}, {_ROC.format(k='lang', t='dl')} SELECT * FROM ap")
def j5(spark, d):
    return M.aupr(doc_scores(spark, d), ["lang"])


@query("j6_fpr_at_tpr", "lang:s target:d fpr:d", f"{_DL}, {_ROC.format(k='lang', t='dl')} SELECT lang, target, CASE WHEN max(nt) > 0 THEN coalesce(min(fp / nullif(nt, 0)) FILTER (WHERE tp / nullif(pt, 0) >= target), 1.0) END AS fpr FROM roc, (VALUES (0.8::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE)) v(target) GROUP BY 1, 2")
def j6(spark, d):
    return M.fpr_at_tpr(doc_scores(spark, d), ["lang"], (0.8, 0.9, 0.95))


@query("j11_openset", "lang:s auroc:d aupr:d fpr95:d", f"{_EL}, {_AUC.format(k='lang', t='el')}, {_ROC.format(k='lang', t='el')} SELECT lang, auroc, aupr, (SELECT coalesce(min(fp / nullif(nt, 0)) FILTER (WHERE tp / nullif(pt, 0) >= 0.95::DOUBLE), 1.0) FROM roc WHERE roc.lang = auc.lang) AS fpr95 FROM auc JOIN ap USING (lang)")
def j11(spark, d):
    return M.openset_metrics(event_scores(spark, d), ["lang"], label="label")


@query("j14_reliability", "lang:s bin:l mean_score:d frac_pos:d", f"{_DL}, b AS (SELECT *, ntile(10) OVER (PARTITION BY lang ORDER BY score, image_id) - 1 AS bin FROM dl) SELECT lang, bin, avg(score) AS mean_score, avg(label) AS frac_pos FROM b GROUP BY 1, 2")
def j14(spark, d):
    return M.reliability(doc_scores(spark, d), ["lang"])


@query("j15_paired_shift", "k:l mean_a:d min_b:d pass_a:d pass_b:d mean_drop:d margin_change:d argmax_b:d", f"""{MEAN}, a AS (SELECT sc.image_id, sc.k, own.k AS own, score AS sa, score * 0.5 - (CASE WHEN sc.k = 0 THEN 0.02 ELSE 0 END) AS sb FROM sc JOIN (SELECT image_id, k FROM sc WHERE label = 1 AND NOT contains(combo, '_')) own USING (image_id)),
    i AS (SELECT image_id, own AS k, max(sa) FILTER (WHERE k = own) AS oa, max(sb) FILTER (WHERE k = own) AS ob, max(sa) FILTER (WHERE k <> own) AS ra, max(sb) FILTER (WHERE k <> own) AS rb FROM a GROUP BY 1, 2)
    SELECT k, avg(oa) AS mean_a, min(ob) AS min_b, avg(CASE WHEN oa > 0.1 THEN 1.0::DOUBLE ELSE 0 END) AS pass_a, avg(CASE WHEN ob > 0.1 THEN 1.0::DOUBLE ELSE 0 END) AS pass_b, avg(oa) - avg(ob) AS mean_drop, avg(ob - rb) - avg(oa - ra) AS margin_change, avg(CASE WHEN ob >= rb THEN 1.0::DOUBLE ELSE 0 END) AS argmax_b FROM i GROUP BY 1""")
def j15(spark, d):
    at = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("combo")) - 1
    a = image_scores(spark, d).withColumn("k", at.cast("int")).where("k >= 0").select("image_id", "k", "scores")
    b = a.withColumn("scores", F.transform("scores", lambda x, i: x * 0.5 - F.when(i == 0, 0.02).otherwise(0.0)))
    thr = spark.createDataFrame([(k, 0.1) for k in range(5)], "k int, threshold double")
    return M.paired_shift(a, b, thr)


# ---- intervals -------------------------------------------------------------------

_CONC = "cc AS (SELECT p.k, p.combo AS u, n.combo AS v, sum(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5 ELSE 0 END) AS c FROM sc p JOIN sc n ON p.k = n.k AND p.label = 1 AND n.label = 0 GROUP BY 1, 2, 3)"


@query("k2_concordance", "k:l u:s v:s c:d", f"{MEAN}, {_CONC} SELECT * FROM cc")
def k2(spark, d):
    return I.concordance(image_scores(spark, d))


# a fixed draw table both engines can form: unit i enters resample b with weight (7 b + 3 i) mod 4
_DRAW = "un AS (SELECT combo AS u, row_number() OVER (ORDER BY combo) - 1 AS i FROM (SELECT DISTINCT combo FROM fx_images)), dr AS (SELECT b, u, (7 * b + 3 * i) % 4 AS w FROM un, range(40) r(b) WHERE (7 * b + 3 * i) % 4 > 0 UNION ALL SELECT -1, u, 1 FROM un)"
_BOOT = f"""{PRED}, {PER_IMAGE}, {_DRAW}, {_CONC},
pu AS (SELECT combo AS u, count(*) AS n, sum(f1) AS f1, sum(2.0::DOUBLE * nt / (5 + nt)) AS fa FROM f GROUP BY 1),
b1 AS (SELECT b, sum(w * f1) / sum(w * n) AS f1, sum(w * (f1 - fa)) / sum(w * n) AS f1_margin FROM dr JOIN pu USING (u) GROUP BY 1),
ck AS (SELECT combo AS u, k, sum(pred * label) AS tp, sum(pred) AS np, sum(label) AS p, count(*) AS n FROM pr GROUP BY 1, 2),
bk AS (SELECT b, k, sum(w * tp) AS tp, sum(w * np) AS np, sum(w * p) AS p, sum(w * n) AS n FROM dr JOIN ck USING (u) GROUP BY 1, 2),
b2 AS (SELECT b, avg(CASE WHEN np + p > 0 THEN 2.0::DOUBLE * tp / (np + p) ELSE 0 END) AS macro, avg((CASE WHEN np + p > 0 THEN 2.0::DOUBLE * tp / (np + p) ELSE 0 END) - 2.0::DOUBLE * p / (n + p)) AS macro_margin FROM bk GROUP BY 1),
wn AS (SELECT a.b, cc.k, sum(a.w * z.w * c) AS s FROM cc JOIN dr a ON a.u = cc.u JOIN dr z ON z.u = cc.v AND z.b = a.b GROUP BY 1, 2),
ba AS (SELECT b, k, coalesce(s, 0) / (p * (n - p)) AS a FROM bk LEFT JOIN wn USING (b, k) WHERE p * (n - p) > 0),
vals AS (SELECT b, 'f1' AS metric, f1 AS v FROM b1 UNION ALL SELECT b, 'f1_margin', f1_margin FROM b1 UNION ALL SELECT b, 'macro', macro FROM b2 UNION ALL SELECT b, 'macro_margin', macro_margin FROM b2
  UNION ALL SELECT b, 'auroc_mean', avg(a) FROM ba GROUP BY b UNION ALL SELECT b, 'auroc_' || CAST(k AS VARCHAR), a FROM ba)"""
_REPORT = "SELECT metric, max(v) FILTER (WHERE b = -1) AS point, quantile_cont(v, 0.025) FILTER (WHERE b >= 0) AS lo, quantile_cont(v, 0.975) FILTER (WHERE b >= 0) AS hi, coalesce(quantile_cont(v, 0.025) FILTER (WHERE b >= 0) > 0.5 OR quantile_cont(v, 0.975) FILTER (WHERE b >= 0) < 0.5, false) AS resolved FROM vals GROUP BY 1"


@query("k1_bootstrap", "metric:s point:d lo:d hi:d resolved:b", f"{_BOOT} {_REPORT}")
def k1(spark, d):
    p = predictions(spark, d)
    units = I.unit_list(p)
    index = F.array(*[F.lit(u) for u in units])
    draws = spark.range(40).select(F.col("id").alias("b"), F.posexplode(index).alias("i", "u"))
    draws = draws.select("b", "u", ((7 * F.col("b") + 3 * F.col("i")) % 4).alias("w")).where("w > 0")
    point = spark.createDataFrame([(-1, u, 1) for u in units], "b bigint, u string, w bigint")
    return I.bootstrap_report(p, draws=draws.unionByName(point))


@query("k1_bootstrap_drawn", "metric:s point:d lo:d hi:d resolved:b")
def k1_drawn(spark, d):
    """2,000 resamples of the library's own draws; the intervals are stochastic."""
    return I.bootstrap_report(predictions(spark, d), n_boot=2000, seed=0)
