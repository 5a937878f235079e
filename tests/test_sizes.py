"""What shows only on larger tables, provoked on small ones."""

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import prototypes as P


def test_rename_query_follows_five_characters_and_plan_stays_unique(spark, tmp_path):
    from tessella.catalog import load
    from tessella.operators.splits import rename_plan
    from tests.oracle import rows_of

    import duckdb

    n = 100_010
    events = spark.range(n, numPartitions=2).select(F.col("id").alias("event_id"), F.lit(7).cast("bigint").alias("user_id"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    q = load()["b6_rename_plan"]
    df, cur = q.run(spark, str(tmp_path)), con.execute(q.sql)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in cur.description], cur.fetchall())
    name = F.format_string("frame_%d_aug_%03d.jpg", F.floor(F.col("event_id") / 3), F.col("event_id") % 3)
    plan = rename_plan(events.select(F.lit("u").alias("folder"), name.alias("name")))
    assert plan.select("new_name").distinct().count() == n


def test_counts_of_vector_totals_are_whole(spark):
    counts = [[int(c) for c in np.random.default_rng(g).integers(1, 60_000, 37)] for g in range(40)]
    rows = [(g, [0.5 * c, 1.0], float(c)) for g, each in enumerate(counts) for c in each]
    df = spark.createDataFrame(rows, "g int, s array<double>, n double").repartition(7)
    got = {r["g"]: r["n"] for r in P.add_vectors(df, ["g"]).collect()}
    assert got == {g: float(sum(each)) for g, each in enumerate(counts)}


def test_knn_blocks_grow_with_the_table():
    from tessella.operators import knn as KNN

    for n in (615_000, 102_564):  # each row is sent once for every block of the other side
        assert KNN._blocks(n, 64) <= KNN.MOST_BLOCKS
    assert KNN._blocks(100, 16) == 7 and KNN._blocks(0, 16) == 0
    assert KNN._blocks(10**8, 64) * KNN.LARGEST_BLOCK >= 10**8


def test_held_blocks_are_dealt_over_all_cores_and_sum_alike(spark):
    from tessella.operators import clusters as CL

    z = np.random.default_rng(5).standard_normal((30_000, 4)).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(z)]
    df = spark.createDataFrame(rows, "i bigint, z array<float>").coalesce(1)
    fn = lambda i, m: np.concatenate([m.sum(axis=0), [i.sum(), len(i)]])
    with CL.held_blocks(df, ["i", "z"]) as held:
        assert held.count() == len(z) and held.df.rdd.getNumPartitions() == 8
        assert max(held.df.rdd.glom().map(len).collect()) <= 2  # 12 blocks
        got = CL.task_sums(held, ["i", "z"], fn)
    assert np.allclose(got, CL.task_sums(df, ["i", "z"], fn)) and round(got[-1]) == len(z)
    with CL.held_blocks(df.where("i < 0"), ["z"]) as none:
        assert none.isEmpty() and len(CL.task_sums(none, ["z"], lambda m: m.sum(axis=0))) == 0
