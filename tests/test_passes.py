"""How often rows are read or compared by jobs that share their work, and that sharing changes no result."""

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import fit as FT
from tessella.operators import frames as FR
from tessella.operators import knn as KNN
from tessella.operators import multifit as MF
from tessella.plans import ablations as A
from tessella.plans import decoders as D
from tessella.plans import openset as O
from tests.test_multifit import CLASSES, collection

SPLIT = "CASE image_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split"


def close(a, b):
    rows = [sorted(tuple(r) for r in df.collect()) for df in (a, b)]
    return len(rows[0]) == len(rows[1]) and all(x == y or abs(x - y) < 1e-9 for r, s in zip(*rows) for x, y in zip(r, s))


def test_folds_share_the_search_in_a_cell(monkeypatch):
    g = np.random.default_rng(5)
    q, pool = g.standard_normal((40, 8)), np.repeat(g.standard_normal((1500, 8)), 2, axis=0)  # every row twice: ties
    masks = [g.random(3000) < share for share in (1.0, 0.6, 0.3, 0.002)] + [np.zeros(3000, dtype=bool)]
    seen, real = [], np.partition
    monkeypatch.setattr(KNN.np, "partition", lambda a, *args, **kw: (seen.append(a.size), real(a, *args, **kw))[1])
    tops = KNN._top(q, pool, masks, 10)
    monkeypatch.undo()
    for top, mask in zip(tops, masks):
        want = np.full((40, 10), -np.inf)
        best = -np.sort(-(q @ pool.T)[:, mask], axis=1)[:, :10]
        want[:, : best.shape[1]] = best
        assert np.allclose(top, want)
    assert sum(seen) < q.shape[0] * len(pool)  # one fold alone has as many


def test_queries_of_a_sent_pool_are_dealt_over_all_cores(spark):
    _, t = collection(spark)
    few = t.coalesce(1)
    assert KNN.knn_top(few, t, 3).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert KNN.knn_top(few, t, 3).count() == few.count()


def test_stages_share_the_neighbours_of_validation(spark, monkeypatch):
    im, t = collection(spark)
    im, calls, real = im.selectExpr("*", SPLIT), [], KNN.knn_distance
    monkeypatch.setattr(KNN, "knn_distance", lambda *a, **kw: (calls.append(len(a[4])), real(*a, **kw))[1])
    both = O.openworld_variants(im, t, CLASSES, knn_k=3)
    assert calls == [9, 3]  # validation for 3 outer and 6 inner folds, then test
    alone = O.openworld_variants(im, t, CLASSES, knn_k=3, inner=False)
    assert close(both.where("stage = 'outer'").drop("stage", "k_in").na.fill(-1.0), alone.drop("stage", "k_in").na.fill(-1.0))
    assert both.where("stage = 'inner'").select("k_star", "k_in").distinct().count() == 6


def test_mosaic_pools_share_their_passes(spark, monkeypatch):
    im, t = collection(spark)
    im = im.selectExpr("*", SPLIT)
    label = F.transform("label", lambda x: x.cast("double")).alias("label")
    pool = lambda parity: t.join(im.where(f"image_id % 2 = {parity} AND split = 'train'").select("image_id", label), "image_id")
    passes, real = [], MF.task_sums
    spy = lambda *a, **kw: (passes.append(1), real(*a, **kw))[1]
    monkeypatch.setattr(MF, "task_sums", spy)
    monkeypatch.setattr(FT, "task_sums", spy)
    together = A.mosaic_stage(pool(0), pool(1), im, t, CLASSES, epochs=4, lr=1e-2, absent_lambda=0.5)
    assert len(passes) <= 4 + 1
    one_by_one = A.mosaic_stage(pool(0), pool(1), im, t, CLASSES, epochs=4, lr=1e-2, absent_lambda=0.5, tau_r=0.1)
    assert close(together.select("pool", "per_sample_f1", "macro_f1"), one_by_one.select("pool", "per_sample_f1", "macro_f1"))


def test_probe_scores_are_made_once(spark):
    im, t = collection(spark)
    read, n = spark.sparkContext.accumulator(0), t.count()

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    out = D.compare_encoders({"one": t.mapInArrow(counted, t.schema)}, im.selectExpr("*", SPLIT), CLASSES, lr_grid=(0.1, 1.0), epochs=2)
    assert out.count() == 20  # two rules, two splits, five metrics
    assert read.value <= 5 * n  # dimension, fit, two validations, final scores


class Counting:
    """An encoder that counts the tiles it sees."""

    def __init__(self, seen):
        self.seen, self.inner = seen, FR.ProjectionEncoder(6, 2, 3)

    def __call__(self, x):
        self.seen.add(len(x))
        return self.inner(x)


def test_arms_encode_their_frames_once(spark):
    im, _ = collection(spark)
    g, seen = np.random.default_rng(8), spark.sparkContext.accumulator(0)
    frames = spark.createDataFrame([(i, 8, 8, g.integers(0, 256, 192).astype(np.uint8).tobytes()) for i in range(90)], FR.FRAME)
    arms = {m: {"size": 4, "n": 2, "method": m, "sigma": 2.0, "downsample": 2} for m in ("divide", "none")}
    out = A.sweep_frames(im.selectExpr("*", SPLIT), frames, CLASSES, Counting(seen), arms)
    assert out.count() == 4 and seen.value == 2 * 90 * 4
