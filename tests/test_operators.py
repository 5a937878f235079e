import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions import labels as L
from tessella.functions import vectors as V
from tessella.functions.kernels import sparsemax_rows, unit_rows
from tessella.model import PrototypeModel
from tessella.operators import calibrate as C
from tessella.operators import clusters as CL
from tessella.operators import fit as FT
from tessella.operators import frames as FR
from tessella.operators import intervals as I
from tessella.operators import knn as KNN
from tessella.operators import metrics as M
from tessella.operators import prototypes as P
from tessella.operators import scoring as S
from tessella.operators import splits as SP
from tessella.operators.isotonic import isotonic

rng = np.random.default_rng(4)


def vectors(spark, n=120, d=6, seed=0):
    z = np.random.default_rng(seed).standard_normal((n, d))
    rows = [(i // 2, i % 2, [float(x) for x in v]) for i, v in enumerate(z)]
    return spark.createDataFrame(rows, "image_id bigint, tile_idx int, z array<double>"), unit_rows(z)


def wide(spark, scores, labels, combos=None):
    rows = [
        (i, combos[i] if combos else "x", [float(v) for v in s], [int(v) for v in y]) for i, (s, y) in enumerate(zip(scores, labels))
    ]
    return spark.createDataFrame(rows, "image_id bigint, combo string, scores array<double>, label array<int>")


# ---- labels and splits -----------------------------------------------------------


def test_take_suffixes_and_twins(spark):
    df = spark.createDataFrame([("bs_ka_take2",), ("bs_ka_TAKE10",), ("bs__ka",), ("ka_bs",)], "combo string")
    got = df.select(L.parse_tokens("combo").alias("t"), L.label_key("combo").alias("k")).collect()
    assert [sorted(r.t) for r in got] == [["bs", "ka"]] * 4 and {r.k for r in got} == {"bs_ka"}
    held = spark.createDataFrame([("bs_ka",)], "combo string")
    assert SP.drop_label_sets(df, held).count() == 0


@pytest.mark.parametrize("n", [1, 5, 15, 25, 26])
def test_temporal_split_rounds_half_to_even(spark, n):
    df = spark.createDataFrame([("a", f"{i:04d}.jpg") for i in range(n)], "combo string, path string")
    got = dict(SP.temporal_split(df).groupBy("split").count().collect())
    n_train = min(round(0.8 * n), n)
    n_val = min(round(0.1 * n), n - n_train)
    assert (got.get("train", 0), got.get("val", 0), got.get("test", 0)) == (n_train, n_val, n - n_train - n_val)


def test_even_sampling_cases(spark):
    f = lambda total, n: spark.range(1).select(SP.even_indices(F.lit(total), n)).first()[0]
    assert f(10, 4) == [0, 2, 5, 7] and f(10, 20) == list(range(10))


def test_lco_rules(spark):
    combos = ["a", "b", "c", "a_b", "b_a", "a_c", "b_c", "a_b_c"]
    df = spark.createDataFrame([(c,) for c in combos], "combo string")
    for seed in range(5):
        roles = {r["combo"]: r["role"] for r in SP.select_heldout(df, {1: 1, 2: 2}, seed).collect()}
        key = lambda c: "_".join(sorted(c.split("_")))
        held = {key(c) for c, r in roles.items() if r == "heldout"}
        trained = [c for c, r in roles.items() if r == "trained"]
        assert not held & {key(c) for c in trained}
        assert {"a", "b", "c"} <= {t for c in trained for t in c.split("_")}
        assert sum(r == "heldout" for r in roles.values()) == 3
    with pytest.raises(Exception, match="covered"):
        SP.select_heldout(spark.createDataFrame([("a",), ("b",)], "combo string"), {1: 1}, 0).collect()


def test_folds_cover_and_partition(spark):
    combos = [f"{a}_{b}" for i, a in enumerate("abcd") for b in "abcd"[i + 1 :]] + list("abcd") + ["a_b_c", "b_c_d"]
    df = spark.createDataFrame([(c,) for c in combos], "combo string")
    folds = SP.build_folds(df, 4, 1)
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert sum(sizes) == 8 and max(sizes) - min(sizes) <= 1
    assert SP.fold_coverage(df, folds, 4).count() == 0


def test_splits_do_not_depend_on_partitioning(spark):
    df = spark.range(500).select(F.col("id").alias("image_id"))
    a = SP.random_split(df.repartition(1), 3).orderBy("image_id").collect()
    b = SP.random_split(df.repartition(11), 3).orderBy("image_id").collect()
    assert a == b and {r.split for r in a} == {"train", "val", "test"}


def test_mixup(spark):
    t, _ = vectors(spark, 40)
    t = t.withColumn("label", F.array((F.col("image_id") % 2).cast("int"), F.lit(0)))
    m = SP.mixup(t, 1, 0.4).collect()
    assert len(m) == 40 and all(0 <= r.lam <= 1 for r in m)


@pytest.mark.parametrize("alpha", [0.2, 2.0, 5.0])
def test_mixup_weights_are_beta(spark, alpha):
    t = spark.range(4000).selectExpr("id AS image_id", "0 AS tile_idx", "array(1.0D) AS z", "array(1) AS label")
    lam = np.array([r.lam for r in SP.mixup(t, 3, alpha).select("lam").collect()])
    assert abs(lam.mean() - 0.5) < 0.02 and abs(lam.var() * 4 * (2 * alpha + 1) - 1) < 0.08


# ---- scoring ---------------------------------------------------------------------


def test_kernel_equals_column_functions(spark):
    t, z = vectors(spark)
    p = unit_rows(rng.standard_normal((4, 6)))
    m = PrototypeModel(tuple("abcd"), p)
    mat = F.array(*[V.vector_literal(r) for r in p])
    got = S.score_tiles(t, m, ("sims", "weights", "residual", "energy@0.1", "best"), ("image_id", "tile_idx", "z"))
    w = V.sparsemax(V.logits(V.cosine_scores("z", mat), 10.0))
    twin = got.select("*", V.cosine_scores("z", mat).alias("s2"), w.alias("w2"), V.residual_norm("z", w, mat, 6).alias("r2"), V.energy(V.cosine_scores("z", mat), 0.1).alias("e2"))
    for r in twin.collect():
        assert np.allclose(r.sims, r.s2) and np.allclose(r.weights, r.w2) and abs(r.residual - r.r2) < 1e-9
        assert abs(r["energy@0.1"] - r.e2) < 1e-9 and r.best == int(np.argmax(r.sims))


def test_models_in_one_pass(spark):
    t, _ = vectors(spark)
    ms = {f: PrototypeModel(("a", "b"), unit_rows(rng.standard_normal((2, 6)))) for f in (3, 8)}
    both = S.score_models(t, ms, ("sims",))
    for f, m in ms.items():
        a = both.where(F.col("fold") == f).drop("fold").orderBy("image_id", "tile_idx").collect()
        b = S.score_tiles(t, m).orderBy("image_id", "tile_idx").collect()
        assert a == b


def test_image_without_tiles_scores_zero(spark):
    t, _ = vectors(spark, 4)
    s = S.tile_mean(S.score_tiles(t, PrototypeModel(("a", "b"), np.eye(2, 6))), 2)
    got = {r.image_id: r.scores for r in S.with_empty_images(s, spark.range(3).withColumnRenamed("id", "image_id"), 2).collect()}
    assert got[2] == [0.0, 0.0] and any(got[0])


def test_hybrid_fallback_and_missing_class(spark):
    t, z = vectors(spark, 40)
    im = spark.createDataFrame([(i, "a" if i % 2 else "a_b") for i in range(20)], "image_id bigint, combo string")
    m = P.hybrid_prototypes(t, im, ["a", "b"])
    assert m.source == ("pure", "any")
    mask = np.repeat(np.arange(20) % 2 == 0, 2)
    assert np.allclose(m.matrix[1], unit_rows(z[mask].mean(axis=0)[None])[0])
    assert P.pure_prototypes(t, im, ["a", "b"]) is None
    with pytest.raises(ValueError):
        P.hybrid_prototypes(t, im, ["a", "b", "c"])


def test_knn_paths_agree_with_brute_force(spark):
    q, zq = vectors(spark, 60, seed=1)
    p, zp = vectors(spark, 90, seed=2)
    p = p.withColumn("label", F.array((F.col("image_id") % 3 == 0).cast("int"), F.lit(0)))
    lab = (np.arange(90) // 2) % 3 == 0
    sims = zq @ zp.T
    want = {(f, i): 1 - np.sort(sims[i][~lab] if f == 0 else sims[i])[-5] for f in (0, 1) for i in range(60)}
    for kw in ({}, {"send_limit": 0, "block_rows": 16}):
        got = KNN.knn_distance(q, p, 5, excludes=[[0], []], **kw).collect()
        assert len(got) == 120
        assert all(abs(r.knn - want[r.fold, r.image_id * 2 + r.tile_idx]) < 1e-9 for r in got)
        # a key that two queries share does not mix them
        some = KNN.knn_distance(q, p, 5, keep=("image_id",), excludes=[[], []], **kw).where("fold = 1").collect()
        assert sorted((r.image_id, round(r.knn, 9)) for r in some) == sorted((i // 2, round(want[1, i], 9)) for i in range(60))


# ---- calibration and metrics -----------------------------------------------------


def brute_f1(scores, labels, grid):
    best, at = -1.0, None
    for t in grid:
        p = scores > t
        tp, fp, fn = (p & (labels == 1)).sum(), (p & (labels == 0)).sum(), (~p & (labels == 1)).sum()
        f = 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0
        if f > best + 1e-15:
            best, at = f, t
    return at, best


@pytest.mark.parametrize("grid", ["fixed", "minmax"])
def test_argmax_f1_equals_brute_force(spark, grid):
    s, y = np.round(rng.random((150, 3)), 2), (rng.random((150, 3)) < 0.4).astype(int)
    got = {r.k: r for r in C.argmax_f1_thresholds(wide(spark, s, y), grid).collect()}
    for k in range(3):
        points = np.linspace(0.01, 0.99, 99) if grid == "fixed" else s[:, k].min() + np.arange(198) * ((s[:, k].max() - s[:, k].min()) / 198)
        at, best = brute_f1(s[:, k], y[:, k], points)
        assert abs(got[k].f1 - best) < 1e-12 and abs(got[k].threshold - at) < 1e-12


def test_thresholds_without_positives_and_constant_scores(spark):
    df = wide(spark, [[0.2, 0.7]] * 4, [[1, 0]] * 4)
    by = lambda t: {r.k: r.threshold for r in t.collect()}
    assert by(C.quantile_thresholds(df)) == {0: 0.2, 1: 0.05}
    assert by(C.quantile_thresholds(df, 0.05, C.FALLBACK_MATCH))[1] == 0.5
    assert by(C.quantile_thresholds(df, 0.05, C.NEVER_FIRES))[1] == 1.7
    assert {r.k: r.auroc for r in M.class_auroc(df).collect()} == {0: None, 1: None}
    mixed = wide(spark, [[0.3]] * 6, [[1], [0], [1], [0], [0], [1]])
    assert M.class_auroc(mixed).first().auroc == 0.5
    assert M.mean_auroc(mixed).first().auroc_mean == 0.5


def brute_auroc(s, y):
    d = s[y == 1][:, None] - s[y == 0][None, :]
    return ((d > 0) + 0.5 * (d == 0)).mean()


def test_rank_metrics_equal_brute_force(spark):
    s, y = np.round(rng.standard_normal(300), 1), (rng.random(300) < 0.3).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "score": s, "unknown": y}))
    r = M.openset_metrics(df, ["g"]).first()
    assert abs(r.auroc - brute_auroc(s, y)) < 1e-12
    tp = fp = 0
    ap, fpr = 0.0, None
    for v in np.unique(s)[::-1]:
        hit = s == v
        tp, fp = tp + y[hit].sum(), fp + (1 - y[hit]).sum()
        ap += y[hit].sum() / y.sum() * tp / (tp + fp)
        if fpr is None and tp / y.sum() >= 0.95:
            fpr = fp / (1 - y).sum()
    assert abs(r.aupr - ap) < 1e-12 and abs(r.fpr95 - fpr) < 1e-12
    flip = M.auroc(df.withColumn("score", -F.col("score")), ["g"], label="unknown").first().auroc
    cube = M.auroc(df.withColumn("score", F.col("score") ** 3 + 5), ["g"], label="unknown").first().auroc
    assert abs(flip - (1 - r.auroc)) < 1e-12 and abs(cube - r.auroc) < 1e-12


def test_rank_metrics_without_one_class(spark):
    df = spark.createDataFrame([("p", 0.1, 1), ("p", 0.2, 1), ("n", 0.1, 0), ("n", 0.3, 0)], "g string, score double, unknown int")
    r = {x.g: x for x in M.openset_metrics(df, ["g"]).collect()}
    assert all(r[g][m] is None for g in "pn" for m in ("auroc", "aupr", "fpr95"))
    assert {x.g: x.aupr for x in M.aupr(df, ["g"], label="unknown").collect()} == {"p": 1.0, "n": None}
    assert {x.g: x.fpr for x in M.fpr_at_tpr(df, ["g"], label="unknown").collect()} == {"p": None, "n": 1.0}


def test_empty_answers_and_constant_predictor(spark):
    df = spark.createDataFrame([([0, 0], [0, 0]), ([0, 0], [1, 0]), ([1, 1], [1, 1])], "label array<int>, pred array<int>")
    assert abs(M.per_sample_f1(df).first()[0] - 2 / 3) < 1e-12
    for order, want in ((3, 2 / 3), (4, 0.8)):
        one = spark.createDataFrame([([1] * order + [0] * (6 - order),)], "label array<int>")
        assert abs(M.constant_predictor(one).first().per_sample_f1 - want) < 1e-12


def test_nan_and_null_are_skipped(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", None), ("a", 3.0)], "k string, value double")
    r = M.mean_std(df, ["k"]).first()
    assert (r["mean"], r["std"], r["n"]) == (2.0, 1.0, 2)


def test_bootstrap_equals_resampling_the_rows(spark):
    n = 120
    combos = [["a", "b", "a_b", "b_c"][i % 4] for i in range(n)]
    labels = np.array([[int(c in x.split("_")) for c in "abc"] for x in combos])
    scores = np.round(rng.random((n, 3)) + 0.3 * labels, 2)
    preds = wide(spark, scores, labels, combos).withColumn("pred", F.transform("scores", lambda s: (s > 0.6).cast("int")))
    units = I.unit_list(preds)
    draws = I.draw_units(spark, units, 20, 3)
    per_unit, per_class = I.unit_statistics(preds)
    got = {(r.b, r.metric): r.value for r in I.weighted_metrics(per_unit, per_class, I.concordance(preds), draws).collect()}
    drawn = {}
    for r in draws.collect():
        drawn.setdefault(r.b, []).extend([r.u] * r.w)
    pred = (scores > 0.6).astype(int)
    for b, us in drawn.items():
        ii = np.concatenate([np.where(np.array(combos) == u)[0] for u in us])
        tp, s = (labels[ii] & pred[ii]).sum(axis=1), (labels[ii] + pred[ii]).sum(axis=1)
        assert abs(got[b, "f1"] - np.where(s > 0, 2 * tp / np.maximum(s, 1), 1).mean()) < 1e-9
        aucs = []
        for k in range(3):
            y = labels[ii, k]
            if 0 < y.sum() < len(y):
                aucs.append(brute_auroc(scores[ii, k], y))
                assert abs(got[b, f"auroc_{k}"] - aucs[-1]) < 1e-9
        if aucs:  # undefined when a resample has one kind of label only
            assert abs(got[b, "auroc_mean"] - np.mean(aucs)) < 1e-9


def test_isotonic_is_monotone_and_clipped(spark):
    s = rng.random((80, 1))
    y = (rng.random((80, 1)) < s).astype(int)
    df = wide(spark, s, y)
    got = isotonic(df, df.withColumn("raw", F.col("scores")), ["a"]).select("raw", "scores").collect()
    v = np.array(sorted((r.raw[0], r.scores[0]) for r in got))
    assert (np.diff(v[:, 1]) >= -1e-12).all() and v[:, 1].min() >= 0 and v[:, 1].max() <= 1


def max_min(x, y):
    """Isotonic fit by its definition: the largest over starts of the smallest over ends of the means between."""
    at = np.unique(x)
    n, t = np.array([(x == v).sum() for v in at]), np.array([y[x == v].sum() for v in at])
    mean = lambda a, b: t[a : b + 1].sum() / n[a : b + 1].sum()
    return at, np.array([max(min(mean(a, b) for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))])


@pytest.mark.parametrize("span,fan", [(65_536, 16), (5, 2), (1, 3)])
def test_isotonic_is_the_max_min_fit(spark, span, fan):
    """Ties, classes of one value, ranges merged over several levels; applied between and beyond the points."""
    s = np.round(rng.random((60, 2)) * 2 - 0.5, 2)
    s[:20, 1], s[20:, 1] = 0.25, 0.75
    y = (rng.random((60, 2)) < s).astype(int)
    ask = np.concatenate([s, rng.random((40, 2)) * 3 - 1])
    got = isotonic(wide(spark, s, y), wide(spark, ask, np.zeros_like(ask, dtype=int)), ["a", "b"], span, fan)
    got = np.array([r.scores for r in got.orderBy("image_id").collect()])
    for k in range(2):
        assert np.allclose(got[:, k], np.clip(np.interp(ask[:, k], *max_min(s[:, k], y[:, k])), 0, 1))


def test_isotonic_edge_cases(spark):
    schema = "image_id long, scores array<double>, label array<int>, value string, x string"
    inf, nan = float("inf"), float("nan")
    cal = [(0, [0.2, None], [1, 1], "", None), (1, [0.4, nan], [0, 1], "", None), (2, [0.6, inf], [1, 0], "", None), (3, None, None, "", None), (4, [None, 0.5], [1, None], "", None), (0, [0.2, None], [1, 1], "", None)]
    ask = [(0, [0.5, 2.0], None, "a", "b"), (0, [0.5, 2.0], None, "a", "b"), (1, [nan, -inf], None, None, None), (2, [inf, None], None, None, None), (3, None, None, None, None), (4, [], None, None, None), (5, [-inf, 0.3], None, None, None)]
    df = spark.createDataFrame(ask, schema)
    got = isotonic(spark.createDataFrame(cal, schema), df, ["a", "b"])
    assert got.columns == df.columns
    rows = sorted(((r.image_id, r.scores) for r in got.collect()), key=lambda r: r[0])
    mean = 2 / 3
    by = {i: r for i, r in rows}
    assert np.allclose(by[0], [mean + (1 - mean) * (0.5 - 0.4) / (0.6 - 0.4), 1.0]) and sum(i == 0 for i, _ in rows) == 2
    assert np.isnan(by[1][0]) and by[1][1] == 0.0 and by[2] == [1.0, None] and by[3] is None and by[4] == [] and np.allclose(by[5], [mean, 0.3])
    none = spark.createDataFrame([], schema)
    assert isotonic(none, none, ["a", "b"]).count() == 0


# ---- clustering ------------------------------------------------------------------


def leaders_of(close, size):
    """Row l leads when no earlier leader is close to it and `size` rows have it as their first close leader."""
    lead = []
    for l in range(len(close)):
        mine = close[l] & ~close[lead].any(axis=0)
        if mine[l] and mine.sum() >= size:
            lead.append(l)
    return lead


@pytest.mark.parametrize("thr,size,block", [(0.8, 4, 256), (0.6, 8, 7), (0.3, 20, 16), (0.999, 3, 64)])
def test_greedy_clusters_equal_the_sequential_rule(spark, thr, size, block, monkeypatch):
    monkeypatch.setattr(CL, "LEADER_WINDOW", block)
    z = np.random.default_rng(8).standard_normal((160, 3))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(z)]
    df = spark.createDataFrame(rows, "row_id bigint, z array<double>").repartition(5)
    got, f = CL.greedy_clusters(df, thr, size), unit_rows(z)
    close = f @ f.T > thr
    lead = leaders_of(close, size)
    assert len(got) == len(lead)
    first = np.where(close[lead].any(axis=0), close[lead].argmax(axis=0), -1) if lead else np.full(len(f), -1)
    for j, centre in enumerate(got):
        assert (first == j).sum() >= size and np.allclose(centre, f[first == j].mean(axis=0))


def test_sinkhorn_is_a_balanced_scaling(spark):
    t, f = vectors(spark, 80)
    c = unit_rows(rng.standard_normal((3, 6)))
    weights = lambda c, n, eps: np.array([r.q for r in CL.sinkhorn_assign(t, c, n, eps).orderBy("image_id", "tile_idx").collect()])
    q = weights(c, 60, 0.2)
    assert np.allclose(q.sum(axis=1), 1) and np.allclose(q.sum(axis=0), len(f) / 3, rtol=1e-3)
    # a row factor times exp(logit / eps) times a column factor
    rest = np.log(q) - f @ c.T / 0.2
    rest -= rest.mean(axis=1, keepdims=True)
    assert np.allclose(rest, rest.mean(axis=0), atol=1e-9)
    # one more round moves every centre to the weighted mean of the rows
    init = f[:2]
    two, three = (CL.sinkhorn_cluster(t, 2, n, init=init) for n in (2, 3))
    assert np.allclose(three, unit_rows(weights(two, 3, 0.05).T @ f), atol=1e-6)
    assert np.allclose(CL.sinkhorn_cluster(t, 1), unit_rows(f.mean(axis=0)[None]))
    grouped = CL.sinkhorn_cluster_by(t.withColumn("g", F.lit(4)), "g", [4], 2, rounds=2, seed=1)[4]
    assert np.allclose(grouped, CL.sinkhorn_cluster(t, 2, 2, seed=1), atol=1e-8)


def test_planted_class_is_found(spark):
    base = unit_rows(np.eye(4, 8))
    z = np.repeat(base, 15, axis=0) + 0.05 * np.random.default_rng(0).standard_normal((60, 8))
    rows = [(i, 0, [float(x) for x in v]) for i, v in enumerate(z)]
    t = spark.createDataFrame(rows, "image_id bigint, tile_idx int, z array<double>")
    known = PrototypeModel(("a", "b", "c"), base[:3])
    new = CL.propose_prototypes(t, known, 0.5)
    assert new.shape == (1, 8) and new[0] @ base[3] > 0.99
    got = CL.assign_images(t, known.appended(new)).orderBy("image_id").collect()
    assert [r.best for r in got] == np.repeat(range(4), 15).tolist()
    assert len(CL.propose_prototypes(t, known, 5.0)) == 0


# ---- fits ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def planted(spark):
    base, r = unit_rows(np.eye(4, 8)), np.random.default_rng(1)
    z = np.repeat(base, 20, axis=0) + 0.3 * r.standard_normal((80, 8))
    rows = [(i, 0, [float(x) for x in v], [float(i // 20 == k) for k in range(4)]) for i, v in enumerate(z)]
    return spark.createDataFrame(rows, "image_id bigint, tile_idx int, z array<double>, label array<double>")


def test_unmix_loss_falls(planted):
    start = PrototypeModel(tuple("abcd"), unit_rows(np.eye(4, 8) + 0.5))
    for kw in ({}, {"reduction": "element_mean"}, {"absent_lambda": 0.5}, {"learn_tau": True}, {"repulsion_lambda": 0.1}):
        h = FT.fit_unmix(planted, start, 5, 1e-2, **kw).history
        assert h[-1]["loss"] < h[0]["loss"]


def test_fit_is_independent_of_partitioning(planted):
    start = PrototypeModel(tuple("abcd"), unit_rows(np.eye(4, 8) + 0.5))
    a = FT.fit_unmix(planted.repartition(1), start, 3, 1e-2).model.matrix
    b = FT.fit_unmix(planted.repartition(7, "image_id"), start, 3, 1e-2).model.matrix
    assert np.allclose(a, b, atol=1e-9)


def test_heads_learn(planted):
    m, h = FT.fit_channel_head(planted, tuple("abcd"), 25, 5e-2, drop=0.0)
    assert h[-1]["loss"] < 0.8 * h[0]["loss"] and m.weight.shape == (4, 2)
    _, h = FT.fit_channel_head(planted, tuple("abcd"), 4, 5e-2, loss="asl", drop=0.5)
    assert np.isfinite(h[-1]["loss"])
    with pytest.raises(ValueError):
        FT.fit_channel_head(planted, tuple("abc"), 1)
    probe, lr, score = FT.fit_linear_probe(planted, tuple("abcd"), lambda m: float(np.trace(m.weight[:, :4])), (0.1, 5.0), 10)
    assert lr == 5.0 and score > 0


def test_attention_learns(spark, planted):
    im = planted.select((F.col("image_id") / 2).cast("bigint").alias("image_id"), F.transform("label", lambda x: x.cast("int")).alias("label")).distinct()
    t = planted.withColumn("tile_idx", (F.col("image_id") % 2).cast("int")).withColumn("image_id", (F.col("image_id") / 2).cast("bigint"))
    m, h = FT.fit_mil(t, im, tuple("abcd"), hidden=4, epochs=6, lr=5e-2)
    assert h[-1]["loss"] < h[0]["loss"]
    w = FT.attention_weights(t, m).groupBy("image_id").agg(F.sum("attention").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in w)


def test_refinements_keep_shape_and_known_rows(planted):
    known = PrototypeModel(tuple("abc"), unit_rows(np.eye(3, 8)))
    new = unit_rows(np.eye(4, 8)[3:] + 0.2)
    assert FT.refine_kd(planted, known, new, steps=3).shape == (1, 8)
    assert np.allclose(np.linalg.norm(FT.refine_uno(planted, new, steps=3), axis=1), 1)
    out = FT.refine_simgcd(planted.withColumn("label", F.slice("label", 1, 3)), planted, known, new, epochs=2)
    assert out.shape == (1, 8)


# ---- frames ----------------------------------------------------------------------


def test_grid_offsets(spark):
    f = lambda dim, s, n: spark.range(1).select(FR.grid_offsets(F.lit(dim), s, n)).first()[0]
    assert f(2592, 224, 4) == [0, 789, 1579, 2368] and f(1944, 224, 4) == [0, 573, 1147, 1720]
    assert f(301, 100, 1) == [100]
    with pytest.raises(Exception, match="smaller"):
        f(100, 224, 4)


def test_mosaic_tiles_show_their_classes(spark):
    rows = [(k, i, 6, 8, bytes([40 * (j + 1)] * 144)) for j, k in enumerate("ab") for i in range(j * 10, j * 10 + 3)]
    pool = spark.createDataFrame(rows, "class string, image_id bigint, height int, width int, pixels binary")
    combos = spark.createDataFrame([("a_b", ["a", "b"])], "combo string, tokens array<string>")
    tiles = FR.mosaic(pool, combos, 2, 5, quad=3).collect()
    assert len(tiles) == 32 and all(t.size == 6 and len(t.pixels) == 108 for t in tiles)
    plan = {(r.mosaic, r.tile_idx, r.quad): r["class"] for r in FR.mosaic_plan(combos, 2, 5).collect()}
    for t in tiles:
        a = np.frombuffer(t.pixels, np.uint8).reshape(6, 6, 3)
        for q in range(4):
            want = 40 if plan[t.mosaic, t.tile_idx, q] == "a" else 80
            assert (a[(q // 2) * 3 : (q // 2) * 3 + 3, (q % 2) * 3 : (q % 2) * 3 + 3] == want).all()


def test_embed_paths_agree(spark):
    a = rng.integers(0, 255, (10, 12, 3)).astype(np.uint8)
    fr = spark.createDataFrame([(1, 10, 12, bytes(a.tobytes()))], "image_id bigint, height int, width int, pixels binary")
    enc = FR.ProjectionEncoder(8, 2)
    one = FR.embed_frames(fr, enc, 4, 2, method="none").orderBy("tile_idx").collect()
    two = FR.embed_tiles(FR.grid_tiles(fr, 4, 2), enc).orderBy("tile_idx").collect()
    assert np.allclose([r.z for r in one], [r.z for r in two], atol=1e-6)
