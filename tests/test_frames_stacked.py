"""Frames worked on together against each alone, and the memory and passes this takes."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.catalog import frames as CF
from tessella.operators import frames as FR

MANY = np.random.default_rng(3).integers(0, 256, (5, 12, 20, 3)).astype(np.uint8)
SIZES = [(12, 20), (9, 9), (12, 20), (8, 16), (9, 9)]


def rows(spark):
    g = np.random.default_rng(4)
    made = [(i, h, w, g.integers(0, 256, (h, w, 3)).astype(np.uint8)) for i, (h, w) in enumerate(SIZES)]
    return {i: a for i, _, _, a in made}, spark.createDataFrame([(i, h, w, a.tobytes()) for i, h, w, a in made], FR.FRAME)


@pytest.mark.parametrize("name", FR.CORRUPTIONS)
def test_corrupted_stack_equals_each(name):
    out = FR.corrupted(MANY, name, 2, np.arange(5))
    assert all(np.array_equal(out[i], FR.corrupted(MANY[i], name, 2, i)) for i in range(5))


@pytest.mark.parametrize("method", ["divide", "subtract", "none"])
def test_flattened_stack_equals_each(method):
    out = FR.flatten_of(MANY, method, 2.0, 2)
    assert all(np.array_equal(out[i], FR.flatten_of(MANY[i], method, 2.0, 2)) for i in range(5))
    assert np.array_equal(FR.cut(out, 4, 2), np.concatenate([FR.cut(x, 4, 2) for x in out]))


def test_corrupt_of_mixed_sizes(spark):
    pixels, df = rows(spark)
    got = FR.corrupt(df).collect()
    assert len(got) == 19 * len(SIZES)
    for r in got:
        want = FR.corrupted(pixels[r.image_id], r.corruption, r.severity, r.image_id)
        assert (r.height, r.width) == SIZES[r.image_id] and bytes(r.pixels) == want.tobytes()


def test_stacks_are_bounded():
    n = 700
    b = pa.RecordBatch.from_arrays([pa.array([8] * n), pa.array([16] * n), pa.array([bytes(384)] * n)], names=["height", "width", "pixels"])
    parts = list(FR.stacks(b, limit=24 * 8 * 16 * 100))
    assert [len(at) for at, _ in parts] == [100] * 7 and sorted(np.concatenate([at for at, _ in parts])) == list(range(n))


def test_an_encoder_sees_few_tiles(spark):
    frames = spark.range(0, 9000, 1, 1).selectExpr("id AS image_id", "8 AS height", "16 AS width", "cast(repeat('a', 384) AS binary) AS pixels")
    sizes = lambda x: np.full((len(x), 1), float(len(x)))  # tiles of the call
    most = FR.embed_frames(frames, sizes, 8, 2, method="none").agg(F.max(F.col("z")[0]), F.count("*")).first()
    assert most[1] == 36000 and most[0] * 8 * 8 * 3 * 8 <= 4 << 20


def test_weighted_sum(spark):
    g = np.random.default_rng(5)
    values = [g.integers(0, 256, n).astype(np.uint8) for n in (1, 384, 384, 700, 0)]
    df = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(values)] + [(9, None)], "i int, p binary")
    got = {r.i: r.s for r in df.select("i", FR.weighted_sum("p").alias("s")).collect()}
    assert got == {i: sum(int(x) * (at % 251 + 1) for at, x in enumerate(v)) for i, v in enumerate(values)} | {9: None}


def test_catalog_frames(spark, sf):
    """Every pixel by its formula, at two scales."""
    vectors = {r.vec_id: r.embedding for r in CF.table(spark, sf, "embeddings").where("vec_id < 20").collect()}
    for scale in (1, 3):
        for r in CF.frames(spark, sf, scale).where("image_id < 10").collect():
            e = np.hstack([np.array(vectors[2 * r.image_id + half]).astype(float).reshape(8, 8) for half in (0, 1)])
            one = np.stack([np.clip(np.floor((e + 0.5) * 255.0 - 20 * c), 0, 255) for c in range(3)], axis=-1).astype(np.uint8)
            assert bytes(r.pixels) == one.repeat(scale, axis=0).repeat(scale, axis=1).tobytes()


def test_crops_share_their_resampling():
    """Weights of one size are made once; a crop is the same as by single pixels."""
    assert FR.resize_matrix(20, 12, "bilinear", True) is FR.resize_matrix(20, 12, "bilinear", True)
    a, y, x = MANY[0], np.array([[0.0, 3.25], [11.0, 12.5]]), np.array([[0.5, 19.0], [7.75, -1.0]])
    for (r, c), v in np.ndenumerate(y):
        i, j = int(np.clip(np.floor(v), 0, 10)), int(np.clip(np.floor(x[r, c]), 0, 18))
        dv, du = np.clip(v - i, 0, 1), np.clip(x[r, c] - j, 0, 1)
        want = (1 - dv) * ((1 - du) * a[i, j] + du * a[i, j + 1]) + dv * ((1 - du) * a[i + 1, j] + du * a[i + 1, j + 1])
        assert np.allclose(FR.gather(a, y, x)[r, c], want)


def test_moved_frames_are_encoded_in_one_map(spark):
    _, df = rows(spark)
    args = {"size": 4, "n": 2, "sigma": 2.0, "downsample": 2}
    key = lambda r: (r.image_id, r.transform, r.tile_idx)
    names = (*FR.TRANSFORMS, "grayscale")
    got = {key(r): r.z for r in FR.embed_frames(df, CF.ENCODER, moves=names, **args).collect()}
    want = {}
    for name in names:
        alone = FR.embed_frames(FR.transform_frames(df, (name,)), CF.ENCODER, **args)
        want |= {key(r): r.z for r in alone.withColumn("transform", F.lit(name)).collect()}
    assert got == want and len(got) == len(names) * 4 * len(SIZES)


def test_invariance_scores_and_encoder_hold_no_workers_side_by_side(spark, sf, monkeypatch):
    from tessella.plans import ablations as A

    maps, scored = [], A.S.score_tiles
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(A.S, "score_tiles", lambda *a, **kw: [maps.append(plan(out := scored(*a, **kw)).count("MapIn")), out][1])
    got = CF.o17_inv(spark, sf)
    assert got.count() == len(FR.TRANSFORMS) + 1
    assert maps and set(maps) == {1}
