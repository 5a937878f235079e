"""Models fitted together against the same models fitted one by one, and the jobs built on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.kernels import sparsemax_rows, unit_rows
from tessella.model import PrototypeModel
from tessella.operators import clusters as CL
from tessella.operators import fit as FT
from tessella.operators import multifit as MF
from tessella.operators import splits as SP
from tessella.plans import lco as L
from tessella.plans import openset as O

CLASSES = ("a", "b", "c")
D = 12


def collection(spark, n=90, bag=2, seed=0):
    """(images, tiles): every set of classes, tiles near the sum of their classes' directions."""
    g = np.random.default_rng(seed)
    centre = unit_rows(g.standard_normal((3, D)))
    sets = ["a", "b", "c", "a_b", "a_c", "b_c"]
    images, tiles = [], []
    for i in range(n):
        combo = sets[i % 6]
        on = [int(c in combo.split("_")) for c in CLASSES]
        images.append((i, combo, f"{combo}/{i:04}", on))
        for t in range(bag):
            tiles.append((i, t, [float(x) for x in np.array(on) @ centre + 0.3 * g.standard_normal(D)]))
    return (
        spark.createDataFrame(images, "image_id bigint, combo string, path string, label array<int>").cache(),
        spark.createDataFrame(tiles, "image_id bigint, tile_idx int, z array<double>").repartition(4).cache(),
    )


def start(seed):
    return PrototypeModel(CLASSES, unit_rows(np.random.default_rng(seed).standard_normal((3, D))))


def rows_of(images, tiles):
    label = F.transform("label", lambda x: x.cast("double")).alias("label")
    return tiles.join(images.select("image_id", label), "image_id")


def test_together_equals_one_by_one(spark):
    rows = rows_of(*collection(spark))
    keep = [F.col("image_id") % 3 != 0, F.col("image_id") % 3 != 1, F.col("tile_idx") == 0, F.lit(False)]
    jobs = {
        "plain": MF.UnmixJob(start(1), lr=1e-2), "absent": MF.UnmixJob(start(2), 0.7, "element_mean", 2e-2),
        "head": MF.ChannelJob(CLASSES, D, lr=5e-2), "nothing": MF.UnmixJob(start(3)),
    }
    done = MF.fit_together(rows.withColumn("member", MF.member_of(keep)), jobs, 6)
    one = FT.fit_unmix(rows.where(keep[0]).drop("label"), start(1), 6, 1e-2)
    assert np.allclose(done["plain"].matrix, one.model.matrix, atol=1e-10)
    assert np.allclose([h["loss"] for h in jobs["plain"].history], [h["loss"] for h in one.history])
    two = FT.fit_unmix(rows.where(keep[1]), start(2), 6, 2e-2, "element_mean", absent_lambda=0.7)
    assert np.allclose(done["absent"].matrix, two.model.matrix, atol=1e-10)
    head, _ = FT.fit_channel_head(rows.where(keep[2]), CLASSES, 6, 5e-2)
    assert np.allclose(done["head"].weight, head.weight, atol=1e-10) and np.allclose(done["head"].bias, head.bias, atol=1e-10)
    assert np.allclose(done["nothing"].matrix, start(3).matrix)


def test_one_pass_an_epoch(spark):
    """As many jobs for seven models as for one."""
    rows = rows_of(*collection(spark))

    def jobs_run(models):
        group = f"fit-{models}"
        spark.sparkContext.setJobGroup(group, group)
        jobs = {i: MF.UnmixJob(start(i)) for i in range(models)}
        MF.fit_together(rows.withColumn("member", MF.member_of([F.lit(True)] * models)), jobs, 3)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    try:
        jobs_run(2)  # caches are filled
        assert jobs_run(7) == jobs_run(1)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_each_stops_on_its_own(spark):
    rows = rows_of(*collection(spark)).withColumn("member", F.array(F.lit(1.0), F.lit(1.0)))
    jobs = {"slow": MF.UnmixJob(start(1), lr=1e-6), "fast": MF.UnmixJob(start(1), lr=5e-2)}
    MF.fit_together(rows, jobs, 8, tolerance=1e-3)
    assert len(jobs["slow"].history) == 2 and len(jobs["fast"].history) > 4
    empty = MF.fit_together(rows.where("false"), {"x": MF.UnmixJob(start(4))}, 3)
    assert np.allclose(empty["x"].matrix, start(4).matrix)


def test_fitted_folds(spark):
    images, tiles = collection(spark)
    folds = SP.build_folds(images.select("image_id", "combo", "label"), 3, 1)
    models = {f: start(f) for f in range(3)}
    fitted, heads = L.fit_folds(images, tiles, folds, CLASSES, models, epochs=4, lr=1e-2)
    dev = {r.combo: r.fold for r in folds.collect()}
    for f in range(3):
        train = images.where(~F.col("combo").isin([c for c, x in dev.items() if x == f]))
        rows = rows_of(train, tiles)
        assert np.allclose(fitted[f].matrix, FT.fit_unmix(rows.drop("label"), models[f], 4, 1e-2).model.matrix, atol=1e-10)
        assert np.allclose(heads[f].weight, FT.fit_channel_head(rows, CLASSES, 4, 1e-2)[0].weight, atol=1e-10)
    preds = L.nested_cv_fitted(images, tiles, CLASSES, 3, 1, epochs=4)
    got = preds.collect()
    assert {r.key for r in got} == set(L.FITTED) and {(r.combo, r.fold) for r in got} == set(dev.items())
    assert len(got) == 3 * images.where(F.col("combo").isin(list(dev))).count()


def test_granularity_stage(spark):
    images, tiles = collection(spark)
    units = tiles.withColumn("granularity", F.lit("fine")).unionByName(
        tiles.where("tile_idx = 0").withColumn("granularity", F.lit("noise")).withColumn("z", F.transform("z", lambda x, i: F.when(i % 2 == 0, x).otherwise(0.0)))
    )
    role = F.element_at(F.array(*[F.lit(x) for x in ("train", "train", "val", "dev", "test")]), (F.floor(F.col("image_id") / 6) % 5 + 1).cast("int"))
    protocol = images.withColumn("role", role)
    both = L.granularity_stage(units, protocol, CLASSES, ("fine", "noise"), {"mse": 0.0, "absent": 1.0}, ("mean",), 3, 1e-2).cache()
    rows = {(r.granularity, r.variant, r.key): r for r in both.collect()}
    assert len(rows) == 2 * 2 * 2 and all(0 <= r.test_f1 <= 1 and r.dev_auroc is not None for r in rows.values())
    assert L.select_stage(both).first().dev_auroc == max(r.dev_auroc for r in rows.values())
    alone = L.granularity_stage(units, protocol, CLASSES, ("noise",), {"absent": 1.0}, ("mean",), 3, 1e-2).collect()
    for r in alone:
        assert np.allclose(list(r[3:]), list(rows[r.granularity, r.variant, r.key][3:]))


@pytest.mark.parametrize("method", ["uno", "simgcd", "kd"])
def test_refinement_of_all_cells_equals_each(spark, method):
    """All folds and gates in one pass give the proposals of fold by fold and gate by gate."""
    images, tiles = collection(spark, 120)
    split = F.when(F.col("image_id") % 4 == 0, "test").otherwise("train")
    images = images.withColumn("split", split)
    train = images.where("split = 'train'")
    known = O.fold_models(tiles, train, CLASSES, [[k] for k in range(3)])
    test = tiles.join(images.where("split = 'test'").select("image_id"), "image_id", "left_semi")
    gates = (0.3, 0.5)
    g = np.random.default_rng(3)
    new = {(f, i): unit_rows(g.standard_normal((2, D))) for f in known for i in range(2)}
    new[1, 1] = np.zeros((0, D))
    got = O._refined(images, tiles, test, CLASSES, known, gates, dict(new), method, 4)
    for (f, i), centres in new.items():
        if not len(centres):
            assert not len(got[f, i])
            continue
        rows = CL.gated_rows(test, known[f], gates[i])
        if method == "uno":
            want = FT.refine_uno(rows, centres, 4)
        elif method == "kd":
            want = FT.refine_kd(rows, known[f], centres, steps=4)
        else:
            kept = [k for k in range(3) if k != f]
            label = F.array(*[F.col("label")[k].cast("double") for k in kept]).alias("label")
            own = tiles.join(train.where(F.col("label")[f] == 0).select("image_id", label), "image_id")
            want = FT.refine_simgcd(own, test, known[f], centres, 4)
        assert np.allclose(got[f, i], want, atol=1e-8)


def test_discovery_with_refinement(spark):
    images, tiles = collection(spark, 120)
    turn = F.floor(F.col("image_id") / 6) % 4
    images = images.withColumn("split", F.when(turn == 0, "test").when(turn == 1, "val").otherwise("train"))
    out = O.discover_loso(images, tiles, CLASSES, (0.3, 9.0), refine="uno", refine_steps=3).collect()
    assert len(out) == 6 and all((r.n_flagged == 0) == (r.gate == 9.0) for r in out)
    with pytest.raises(ValueError):
        O.discover_loso(images, tiles, CLASSES, (0.3,), refine="other")


# -- leader clustering ------------------------------------------------------------------------------


def one_by_one(z, t, min_size):
    """Means of clusters when rows are visited in order."""
    free, out = np.ones(len(z), bool), []
    close = z @ z.T > t
    for i in range(len(z)):
        if not free[i]:
            continue
        own = close[i] & free & (np.arange(len(z)) >= i)
        if own.sum() >= min_size:
            out.append(z[own].mean(axis=0))
            free &= ~own
        free[i] = False
    return np.array(out).reshape(len(out), z.shape[1])


@pytest.mark.parametrize("bounds,t,min_size", [((8192, 32 << 20), 0.5, 3), ((8192, 32 << 20), 0.2, 8), ((8192, 32 << 20), 0.95, 1), ((17, 32 << 20), 0.5, 3), ((40, 12 * 8 * 6), 0.6, 2)])
def test_greedy_equals_one_by_one(spark, monkeypatch, bounds, t, min_size):
    """Any window and any number of leaders held give the clusters of the row-by-row rule."""
    monkeypatch.setattr(CL, "LEADER_WINDOW", bounds[0])
    monkeypatch.setattr(CL, "LEADER_BYTES", bounds[1])
    z = unit_rows(np.random.default_rng(int(t * 10)).standard_normal((70, 6)))
    z[40] = 0
    z[50:55] = z[49]
    rows = [(3 * i - 20, [float(x) for x in v]) for i, v in enumerate(z)]
    df = spark.createDataFrame(rows, "row_id bigint, z array<double>").repartition(3)
    got, want = CL.greedy_clusters(df, t, min_size), one_by_one(z, t, min_size)
    assert len(got) == len(want) and (not len(want) or np.allclose(got, want))
    if min_size == 8:
        assert CL.greedy_clusters(df.where("false"), t, min_size).shape == (0, 0)


def test_flagged_cells(spark):
    _, tiles = collection(spark, 20)
    models, gates = [start(1), start(2)], (0.2, 0.6)
    for r in MF.flag_cells(tiles, models, gates).collect():
        z = unit_rows(np.array([r.z]))
        want = [float(np.linalg.norm(z - sparsemax_rows(z @ m.matrix.T * m.tau) @ m.matrix) > t) for m in models for t in gates]
        assert r.member == want


def test_leaders_spare_comparisons(spark, monkeypatch):
    """The first leaders take most rows, and what they take is not compared with later seeds."""
    z = unit_rows(np.random.default_rng(12).standard_normal((3000, 8)))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(z)], "row_id bigint, z array<double>").repartition(3)
    opened, bounds = [], CL._seed_bounds
    monkeypatch.setattr(CL, "_seed_bounds", lambda *a: [opened.append(len(a[3])), bounds(*a)][1])
    got, want = CL.greedy_clusters(df, 0.5, 8), one_by_one(z, 0.5, 8)
    assert len(want) > 10 and np.allclose(got, want)
    assert max(opened) <= 512 and sum(opened) < len(z)
