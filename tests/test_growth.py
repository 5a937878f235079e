"""Steps whose cost must not grow faster than their input."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import splits as SP


def planned(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("n", [1, 2, 7, 900])
def test_mixup_pairs_neighbours_in_hash_order(spark, n):
    t = spark.range(n).selectExpr("id AS image_id", "cast(id % 3 AS int) AS tile_idx", "array(cast(id AS double)) AS z", "array(cast(id % 2 AS int)) AS label")
    order = sorted(range(n), key=lambda i: hashlib.md5(f"{i}:{i % 3}:5".encode()).hexdigest())
    after = {i: order[(at + 1) % n] for at, i in enumerate(order)}
    pairs = SP.mixup_pairs(t.repartition(5), 5, 0.4)
    got = pairs.collect()
    assert len(got) == n and all(r["_z"] == [after[r.image_id]] and r["_y"] == [after[r.image_id] % 2] for r in got)
    mixed = {r.image_id: r for r in SP.mixup(t, 5, 0.4).collect()}
    assert all(np.isclose(mixed[r.image_id].z[0], r.lam * r.image_id + (1 - r.lam) * r["_z"][0]) for r in got)
    assert all(mixed[r.image_id].label == [max(r.label[0], r["_y"][0])] for r in got)


def test_mixup_deals_vectors_once(spark):
    t = spark.range(50).selectExpr("id AS image_id", "0 AS tile_idx", "array(1.0D) AS z", "array(1) AS label")
    assert planned(SP.mixup(t, 3)).count("Join") == 1  # the first rows of the ranges
