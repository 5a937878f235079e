import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators import ordering as O


def frame(spark, values, groups=None):
    pdf = pd.DataFrame({"g": groups if groups is not None else ["a"] * len(values), "x": values, "id": range(len(values))})
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("kind", ["normal", "outlier", "hot", "tiny", "negative_zero", "integers"])
def test_running_sums_match_a_global_sort(spark, kind):
    rng = np.random.default_rng(3)
    x = {
        "normal": rng.standard_normal(800),
        "outlier": np.r_[rng.uniform(0.7, 0.7001, 799), 1e12],
        "hot": np.where(rng.random(800) < 0.5, 0.0, rng.random(800)),
        "tiny": 0.1 + np.arange(800) * 1e-16,
        "negative_zero": np.r_[-0.0, 0.0, rng.standard_normal(798)],
        "integers": rng.integers(-5, 5, 800).astype(float),
    }[kind]
    df, pdf = frame(spark, x, rng.choice(["a", "b"], len(x)))
    got = O.running(O.distinct_values(df, ["g"], "x"), ["g"], "x", ["n"]).toPandas()
    for g, part in pdf.groupby("g"):
        mine = got[got.g == g].sort_values("x")
        want = part.x.add(0.0).value_counts().sort_index()
        assert np.allclose(mine.x.values, want.index.values)
        assert (mine.before_n.values == np.r_[0, want.cumsum().values[:-1]]).all()
        assert (mine.total_n == len(part)).all()


def test_descending(spark):
    df, pdf = frame(spark, np.random.default_rng(1).random(300))
    got = O.running(df.withColumn("n", F.lit(1)), ["g"], "x", ["n"], ascending=False).toPandas().sort_values("x", ascending=False)
    assert (got.before_n.values == np.arange(300)).all()


@pytest.mark.parametrize("method", ["linear", "lower"])
def test_quantiles_equal_numpy(spark, method):
    rng = np.random.default_rng(5)
    df, pdf = frame(spark, np.round(rng.standard_normal(501), 2), rng.choice(["a", "b", "c"], 501))
    qs = [0.0, 0.05, 0.5, 0.93, 1.0]
    got = O.exact_quantiles(df, ["g"], "x", qs, method).toPandas()
    for r in got.itertuples():
        want = np.quantile(pdf[pdf.g == r.g].x, r.q, method=method)
        assert abs(r.x - want) < 1e-12


def test_string_positions(spark):
    rng = np.random.default_rng(0)
    names = [f"run/{s}/frame_{i:05d}{t}.jpg" for s in ("a", "ab", "é") for i in rng.permutation(60) for t in ("", "_x")]
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "p": names}))
    got = O.position(df, ["g"], "p").toPandas().set_index("p").pos
    want = {p: i for i, p in enumerate(sorted(names, key=lambda s: s.encode()))}
    assert all(got[p] == want[p] for p in names)


def test_bins_match_array_split(spark):
    rng = np.random.default_rng(2)
    df, pdf = frame(spark, np.where(rng.random(213) < 0.6, 0.0, rng.random(213)))
    got = O.equal_count_bins(df, ["g"], "x", "id", 10).toPandas().sort_values(["x", "id"])
    want = np.concatenate([[i] * len(b) for i, b in enumerate(np.array_split(np.arange(213), 10))])
    assert (got["bin"].values == want).all()


def test_independent_of_partitioning(spark):
    df, _ = frame(spark, np.random.default_rng(9).random(400))
    a = O.exact_quantiles(df.repartition(1), ["g"], "x", [0.3]).first()["x"]
    b = O.exact_quantiles(df.repartition(13, "id"), ["g"], "x", [0.3]).first()["x"]
    assert a == b


def test_infinities_and_nan_have_places(spark):
    inf, nan = float("inf"), float("nan")
    values = [nan, 2.0, -inf, 0.0, inf, -3.5, 1e300, -1e-300]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    got = [r.i for r in O.position(df, [], "x", ["i"]).orderBy("pos").collect()]
    assert got == [2, 5, 7, 3, 1, 6, 4, 0]
    q = {r.q: r.x for r in O.exact_quantiles(df.where("not isnan(x)"), [], "x", [0.0, 0.5, 1.0]).collect()}
    assert q == {0.0: -inf, 0.5: 0.0, 1.0: inf}


def test_many_groups_of_numbers(spark):
    df = spark.range(4000).selectExpr("id % 1000 AS g", "CAST((id * 7919) % 4001 AS double) AS x", "id")
    got = {(r.g, r.id): r.pos for r in O.position(df, ["g"], "x", ["id"]).collect()}
    by = {}
    for r in df.collect():
        by.setdefault(r.g, []).append((r.x, r.id))
    assert got == {(g, i): n for g, rows in by.items() for n, (_, i) in enumerate(sorted(rows))}


def test_paths_with_long_common_prefixes_spread(spark):
    paths = [f"cam{i % 2 + 1}/2024-01-01/run_{i}" for i in range(3000)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, path string")
    got = [r.i for r in O.position(df, [], "path", ["i"]).orderBy("pos").collect()]
    assert got == sorted(range(3000), key=lambda i: paths[i])
    merge = "spark.sql.adaptive.coalescePartitions.enabled"  # small ranges would be put together again
    spark.conf.set(merge, "false")
    cells = O._with_cells(df, [], "path", ["i"], True).groupBy("_fine").count().collect()
    spark.conf.unset(merge)
    assert len(cells) > 1 and max(r["count"] for r in cells) < 1500
