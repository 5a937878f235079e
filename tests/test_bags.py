"""Attention pooling over bags: gradients, long images in parts, and plans without a shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.kernels import sigmoid, unit_rows
from tessella.operators import bags as B
from tessella.operators import clusters as CL
from tessella.operators import fit as FT

CLASSES, D, H = ("a", "b"), 5, 3


def collection(spark, seed=0):
    g = np.random.default_rng(seed)
    sizes = [1, 2, 7, 3, 12, 5]
    z = [g.standard_normal((n, D)) for n in sizes]
    rows = [(i, t, [float(x) for x in v]) for i, own in enumerate(z) for t, v in enumerate(own)]
    labels = [(i, [i % 2, int(i > 2)]) for i in range(len(sizes))]
    return spark.createDataFrame(rows, "image_id bigint, tile_idx int, z array<double>").repartition(3), spark.createDataFrame(labels, "image_id bigint, label array<int>"), z, np.array([l for _, l in labels], float)


def model(parts):
    return FT.AttentionModel(CLASSES, *parts)


def params(seed=1):
    g = np.random.default_rng(seed)
    return [g.standard_normal(s) for s in ((H, D), (H, D), (H,), (2, D), (2,))]


def loss_of(parts, z, y):
    m, out = model(parts), 0.0
    for own, label in zip(z, y):
        f = unit_rows(own)
        a = np.exp(m.energy(f) - m.energy(f).max())
        logits = (a @ f / a.sum()) @ m.weight.T + m.bias
        out += FT.bce_sums(logits[None], label[None])[0]
    return out / y.size


@pytest.mark.parametrize("limit", [100, 4])
def test_gradients(spark, limit):
    """Against finite differences, with all images whole and with some in parts."""
    tiles, labels, z, y = collection(spark)
    rows = B.make_bags(tiles, limit).join(labels, "image_id").cache()
    sizes = {r.image_id: r.n for r in rows.groupBy("image_id").agg(F.sum("n").alias("n")).collect()}
    assert sizes == {i: len(v) for i, v in enumerate(z)} and (rows.count() > len(z)) == (limit == 4)
    parts = params()
    loss, grads = B.split_sums(B.epoch_sums(rows, model(parts), len(z), limit == 4), H, D, 2)
    assert np.isclose(loss, loss_of(parts, z, y))
    for i, g in enumerate(grads):
        want = np.zeros_like(parts[i])
        for at in np.ndindex(want.shape):
            up, down = [p.copy() for p in parts], [p.copy() for p in parts]
            up[i][at] += 1e-5
            down[i][at] -= 1e-5
            want[at] = (loss_of(up, z, y) - loss_of(down, z, y)) / 2e-5
        assert np.allclose(g, want, atol=1e-6), i
    rows.unpersist()


def test_scores_and_fit_do_not_depend_on_parts(spark, monkeypatch):
    tiles, labels, z, _ = collection(spark)
    m = model(params())
    want = {i: sigmoid((lambda f, a: a @ f / a.sum())(unit_rows(v), np.exp(m.energy(unit_rows(v)))) @ m.weight.T + m.bias) for i, v in enumerate(z)}
    for limit in (100, 4):
        got = {r.image_id: r.scores for r in B.score_bags(B.make_bags(tiles, limit), m).collect()}
        assert set(got) == set(want) and all(np.allclose(got[i], want[i]) for i in want)
    one, h1 = FT.fit_mil(tiles, labels, CLASSES, 4, 5, 1e-2)
    monkeypatch.setattr(B, "BAG_TILES", 4)
    two, h2 = FT.fit_mil(tiles, labels, CLASSES, 4, 5, 1e-2)
    assert np.allclose(one.weight, two.weight) and np.allclose(one.v, two.v) and np.allclose([h["loss"] for h in h1], [h["loss"] for h in h2])


def test_an_epoch_is_a_map(spark, tmp_path, monkeypatch):
    """No row of a bag is shuffled in an epoch; one vector a task is."""
    tiles, labels, z, _ = collection(spark)
    B.make_bags(tiles).join(labels, "image_id").write.parquet(str(tmp_path / "bags"))
    rows, seen = spark.read.parquet(str(tmp_path / "bags")), []
    monkeypatch.setattr(CL, "total_vectors", lambda df, keys, f=CL.total_vectors: (seen.append(df), f(df, keys))[1])
    B.epoch_sums(rows, model(params()), len(z), False)
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in seen]
    assert len(plans) == 1 and "MapInArrow" in plans[0] and "Exchange" not in plans[0] and "Generate" not in plans[0]
