"""Combination-level bootstrap intervals from sufficient statistics.

Labels are constant within a resampling unit, so a resample only re-weights units. F1 is
a weighted sum of unit sums, macro F1 of unit counts, and AUROC of the concordance matrix
C[k, u, v] = sum over positives of u and negatives of v of 1[s > s'] + 1/2 1[s = s'].
The images are read once; resamples are matrix products with C, whatever the number of images.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.calibrate import long_scores
from tessella.operators.metrics import sample_f1
from tessella.operators.ordering import running
from tessella.session import durable

UNITS_PER_PASS = 128
RESAMPLES, CELL_PAIRS = 256, 1_000_000  # resamples and matrix entries of a cell, about


def unit_list(preds: DataFrame, unit: str = "combo") -> list[str]:
    """Sorted resampling units (combinations: tens to thousands)."""
    return sorted(r[0] for r in preds.select(unit).distinct().collect())


def concordance(scores: DataFrame, unit: str = "combo", units: Sequence[str] | None = None) -> DataFrame:
    """(k, u, v, c) for the pairs with a positive in u and a negative in v."""
    units = list(units) if units is not None else unit_list(scores, unit)
    long = long_scores(scores, [unit]).where(F.col("score").isNotNull())
    out = None
    for i in range(0, len(units), UNITS_PER_PASS):
        chunk = units[i : i + UNITS_PER_PASS]
        part = _concordance_pass(long, unit, units, chunk)
        out = part if out is None else out.unionByName(part)
    return out


def _concordance_pass(long: DataFrame, unit: str, units: Sequence[str], negatives: Sequence[str]) -> DataFrame:
    """Running negatives of every unit in `negatives`, met by each positive."""
    label, at = F.col("label").cast("bigint"), F.col(unit)
    pos = F.map_from_entries(
        F.filter(F.collect_list(F.struct("_u", "_pos")), lambda e: e["_pos"] > 0)
    )
    per = long.groupBy("k", "score", at.alias("_u")).agg(
        F.sum(label).alias("_pos"), F.sum(F.lit(1) - label).alias("_neg")
    )
    neg = [
        F.sum(F.when(F.col("_u") == v, F.col("_neg")).otherwise(0)).alias(f"n{j}") for j, v in enumerate(negatives)
    ]
    g = per.groupBy("k", "score").agg(*neg, pos.alias("_p"))
    r = running(g, ["k"], "score", [f"n{j}" for j in range(len(negatives))])
    ahead = [(F.col(f"before_n{j}") + F.col(f"n{j}") / F.lit(2.0)).alias(f"a{j}") for j in range(len(negatives))]
    met = r.select("k", F.explode("_p").alias("u", "pos"), *ahead)
    sums = met.groupBy("k", "u").agg(*[F.sum(F.col("pos") * F.col(f"a{j}")).alias(f"c{j}") for j in range(len(negatives))])
    entries = F.array(*[F.struct(F.lit(v).alias("v"), F.col(f"c{j}").alias("c")) for j, v in enumerate(negatives)])
    totals = per.groupBy("k", F.col("_u").alias("v")).agg(F.sum("_neg").alias("_nv")).where("_nv > 0")
    flat = sums.select("k", "u", F.explode(entries).alias("e")).select("k", "u", "e.v", "e.c")
    return flat.join(F.broadcast(totals.select("k", "v")), ["k", "v"]).select("k", "u", "v", "c")


def unit_statistics(preds: DataFrame, unit: str = "combo") -> tuple[DataFrame, DataFrame]:
    """(u, n, f1, f1_all) and (u, k, tp, fp, fn, pos, neg), both a few rows per unit."""
    label_count = F.size(F.filter("label", lambda v: v == 1))
    k = F.size("label")
    f1_all = F.when(k + label_count > 0, 2.0 * label_count / (k + label_count)).otherwise(1.0)
    per_unit = preds.groupBy(F.col(unit).alias("u")).agg(
        F.count("*").alias("n"), F.sum(sample_f1()).alias("f1"), F.sum(f1_all).alias("f1_all")
    )
    long = preds.select(F.col(unit).alias("u"), F.posexplode(F.arrays_zip("pred", "label")).alias("k", "e"))
    hit = lambda p, y: F.sum(((F.col("e.pred") == p) & (F.col("e.label") == y)).cast("bigint"))
    per_class = long.groupBy("u", "k").agg(
        hit(1, 1).alias("tp"), hit(1, 0).alias("fp"), hit(0, 1).alias("fn"), F.sum("e.label").alias("pos"),
        F.sum(1 - F.col("e.label")).alias("neg"),
    )
    return per_unit, per_class


def draw_units(spark, units: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """(b, u, w): how often each unit is drawn in resample b; b = -1 is the point estimate."""
    n = len(units)
    names = F.array(*[F.lit(u) for u in units])
    draws = spark.range(0, n_boot, 1, max(1, n_boot * n // 100_000)).select(
        F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")
    )
    pick = F.pmod(F.xxhash64(F.lit(seed), "b", "i"), F.lit(n)).cast("int")
    drawn = draws.select("b", names[pick].alias("u")).groupBy("b", "u").agg(F.count("*").alias("w"))
    point = spark.range(1).select(
        F.lit(-1).cast("bigint").alias("b"), F.explode(names).alias("u"), F.lit(1).cast("bigint").alias("w")
    )
    return drawn.unionByName(point)


def weighted_wins(conc: DataFrame, draws: DataFrame) -> DataFrame:
    """(b, k, wins): sum over u, v of w[b, u] C[k, u, v] w[b, v].

    Blocks of resamples meet blocks of a class's matrix in cells, and a cell is one matrix
    product, so what leaves it is a number per resample and class, however many units there are.
    """
    parts = max(1, -(-conc.count() // CELL_PAIRS))
    blocks = conc.select("k", F.pmod(F.xxhash64("u"), F.lit(parts)).cast("int").alias("part"), "u", "v", "c")
    resamples = draws.select(F.floor(F.col("b") / RESAMPLES).cast("int").alias("rb"), "b", "u", "w")
    cells = blocks.select("k", "part").distinct().crossJoin(resamples.select("rb").distinct())  # names of cells only
    left = blocks.join(cells, ["k", "part"])
    # fresh names: both sides come from one table
    of = cells.select(F.col("k").alias("k2"), F.col("part").alias("part2"), F.col("rb").alias("rb2"))
    right = resamples.join(of, F.col("rb") == F.col("rb2")).select("k2", "part2", "rb2", F.col("b").alias("b2"), F.col("u").alias("u2"), F.col("w").alias("w2"))
    out = pa.schema([("b", pa.int64()), ("k", pa.int32()), ("wins", pa.float64())])

    def product(key: tuple, c: pa.Table, r: pa.Table) -> pa.Table:
        if not c.num_rows or not r.num_rows:
            return out.empty_table()
        units, at = np.unique(np.concatenate([c.column(n).to_numpy() for n in "uv"] + [r.column("u2").to_numpy()]).astype(str), return_inverse=True)
        u, v, drawn = np.split(at, [c.num_rows, 2 * c.num_rows])
        rows, row = np.unique(u, return_inverse=True)
        matrix = np.zeros((len(rows), len(units)))
        np.add.at(matrix, (row, v), c.column("c").to_numpy())
        b, which = np.unique(r.column("b2").to_numpy(), return_inverse=True)
        weight = np.zeros((len(b), len(units)))
        np.add.at(weight, (which, drawn), r.column("w2").to_numpy())
        wins = ((weight[:, rows] @ matrix) * weight).sum(axis=1)
        return pa.table([b, np.full(len(b), key[0].as_py(), np.int32), wins], schema=out)

    met = left.groupBy("k", "part", "rb").cogroup(right.groupBy("k2", "part2", "rb2"))
    return met.applyInArrow(product, "b bigint, k int, wins double").groupBy("b", "k").agg(F.sum("wins").alias("wins"))


def weighted_metrics(
    per_unit: DataFrame, per_class: DataFrame, conc: DataFrame, draws: DataFrame
) -> DataFrame:
    """(b, metric, value): f1, f1_margin, macro, macro_margin, auroc_mean, auroc_<k>."""
    w = F.col("w")
    f1 = draws.join(per_unit, "u").groupBy("b").agg(
        (F.sum(w * F.col("f1")) / F.sum(w * F.col("n"))).alias("f1"),
        (F.sum(w * (F.col("f1") - F.col("f1_all"))) / F.sum(w * F.col("n"))).alias("f1_margin"),
    )
    c = draws.join(per_class, "u").groupBy("b", "k").agg(
        *[F.sum(w * F.col(x)).alias(x) for x in ("tp", "fp", "fn", "pos", "neg")]
    )
    d = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    d_all = 2 * F.col("pos") + F.col("neg")
    one = F.when(d > 0, 2.0 * F.col("tp") / d).otherwise(0.0)
    every = F.when(d_all > 0, 2.0 * F.col("pos") / d_all).otherwise(0.0)
    macro = c.groupBy("b").agg(F.avg(one).alias("macro"), F.avg(one - every).alias("macro_margin"))
    wins = weighted_wins(conc, draws)
    pairs = c.select("b", "k", (F.col("pos").cast("double") * F.col("neg")).alias("pairs")).where("pairs > 0")
    auc = pairs.join(wins, ["b", "k"], "left").select("b", "k", (F.coalesce("wins", F.lit(0.0)) / F.col("pairs")).alias("auroc"))
    mean = auc.groupBy("b").agg(F.avg("auroc").alias("auroc_mean"))
    flat = lambda df, names: df.select("b", F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).cast("double").alias("value")) for x in names])).alias("e")).select("b", "e.*")
    out = flat(f1, ["f1", "f1_margin"]).unionByName(flat(macro, ["macro", "macro_margin"])).unionByName(flat(mean, ["auroc_mean"]))
    per = auc.select("b", F.concat(F.lit("auroc_"), F.col("k").cast("string")).alias("metric"), F.col("auroc").alias("value"))
    return out.unionByName(per)


def summarize(values: DataFrame) -> DataFrame:
    """(metric, point, lo, hi, resolved): 2.5 and 97.5 percentiles over the resamples.

    The values are one per resample and metric, so the exact aggregate is bounded.
    """
    boot = F.when(F.col("b") >= 0, F.col("value"))
    out = values.groupBy("metric").agg(
        F.max(F.when(F.col("b") == -1, F.col("value"))).alias("point"),
        F.percentile(boot, 0.025).alias("lo"),
        F.percentile(boot, 0.975).alias("hi"),
    )
    resolved = F.coalesce((F.col("lo") > 0.5) | (F.col("hi") < 0.5), F.lit(False))
    return out.where("point is not null").select("metric", "point", "lo", "hi", resolved.alias("resolved"))


def bootstrap_report(
    preds: DataFrame, unit: str = "combo", n_boot: int = 2000, seed: int = 0, draws: DataFrame | None = None
) -> DataFrame:
    """Point estimates and 95 % intervals; `preds` has unit, scores, label, pred.

    `draws` (b, u, w) overrides the resamples. The per-image rows, the concordance matrix
    and the draws feed several branches, so each is written once to the checkpoint folder.
    """
    preds = durable(preds.select(unit, "scores", "label", "pred"))
    units = unit_list(preds, unit)
    draws = durable(draws if draws is not None else draw_units(preds.sparkSession, units, n_boot, seed))
    per_unit, per_class = unit_statistics(preds, unit)
    return summarize(weighted_metrics(per_unit, per_class, durable(concordance(preds, unit, units)), draws))
