"""Leave-one-class-out open-set and discovery jobs.

The held-out class is a column: every fold is scored in one pass over the test tiles.
`images` has image_id, combo, label, split.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.kernels import unit_rows
from tessella.model import PrototypeModel
from tessella.operators import calibrate as C
from tessella.operators import clusters as CL
from tessella.operators import knn as KNN
from tessella.operators import metrics as M
from tessella.operators import multifit as MF
from tessella.operators import prototypes as P
from tessella.operators import scoring as S
from tessella.operators.ordering import exact_quantiles
from tessella.session import durable

SCORES = ("residual", "neg_max", "energy", "knn", "residual_norm", "knn_norm")


def fold_models(
    tiles: DataFrame, train: DataFrame, classes: Sequence[str], excludes: Sequence[Sequence[int]], tau=10.0
) -> dict[int, PrototypeModel]:
    """Known-class prototypes of every fold.

    A pure culture contains one class only, so leaving classes out removes rows of the
    matrix and changes none. Folds missing a pure culture fall back to k-means.
    """
    rows = P.choose_source(
        P.prototype_sums(tiles, train.where(F.col("combo").isin(list(classes))), classes).where("source = 'pure'")
    ).collect()
    pure = {r["k"]: r["p"] for r in rows}
    out = {}
    for f, gone in enumerate(excludes):
        kept = [k for k in range(len(classes)) if k not in gone]
        if all(k in pure for k in kept):
            m = np.array([pure[k] for k in kept])
            out[f] = PrototypeModel(tuple(classes[k] for k in kept), m, ("pure",) * len(kept), tau, config={"kept": kept})
        else:
            usable = train.where(reduce(lambda a, k: a & (F.col("label")[k] == 0), gone, F.lit(True)))
            km = P.kmeans_prototypes(tiles.join(usable.select("image_id"), "image_id", "left_semi"), len(kept), tau=tau)
            out[f] = PrototypeModel(tuple(classes[k] for k in kept), km.matrix, km.source, tau, config={"kept": kept})
    return out


def _of_split(tiles: DataFrame, images: DataFrame, split: str) -> DataFrame:
    return tiles.join(images.where(F.col("split") == split).select("image_id"), "image_id", "left_semi")


def _melt(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"`{n}`").cast("double").alias("score")) for n in names])
    return df.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.key", "e.score")


def openset_scores(
    images: DataFrame, tiles: DataFrame, classes: Sequence[str], temps: Sequence[float] = (0.1, 1.0), knn_k: int | None = 10
) -> DataFrame:
    """(k_star, key, image_id, unknown, score) on the test split, mean over tiles."""
    excludes = [[k] for k in range(len(classes))]
    train, test = images.where("split = 'train'"), images.where("split = 'test'")
    models = fold_models(tiles, train, classes, excludes)
    names = ["residual", "neg_max", *[f"energy@{t}" for t in temps]]
    test_tiles = _of_split(tiles, images, "test")
    scored = S.score_models(test_tiles, models, names, ("image_id",), "k_star")
    per = scored.groupBy("k_star", "image_id").agg(*[F.avg(f"`{n}`").alias(n) for n in names])
    out = _melt(per, ["k_star", "image_id"], names)
    if knn_k:
        pool = tiles.join(train.select("image_id", "label"), "image_id")
        d = KNN.knn_distance(test_tiles, pool, knn_k, ("image_id", "tile_idx"), excludes)
        mean = d.groupBy(F.col("fold").alias("k_star"), "image_id").agg(F.avg("knn").alias("score"))
        out = out.unionByName(mean.withColumn("key", F.lit("knn")).select(*out.columns))
    label = test.select("image_id", "label")
    return out.join(label, "image_id").withColumn("unknown", F.element_at("label", F.col("k_star") + 1)).drop("label")


def openset_loso(images: DataFrame, tiles: DataFrame, classes: Sequence[str]) -> DataFrame:
    """(k_star, key, auroc, aupr, fpr95) of the residual and the similarity score."""
    s = openset_scores(images, tiles, classes, (), None)
    return M.openset_metrics(durable(s), ["k_star", "key"])


def openset_sweep(
    images: DataFrame, tiles: DataFrame, classes: Sequence[str], k: int = 10, temps: Sequence[float] = (0.1, 1.0)
) -> DataFrame:
    """The same over residual, neg_max, energy at several temperatures and kNN."""
    return M.openset_metrics(durable(openset_scores(images, tiles, classes, temps, k)), ["k_star", "key"])


def knn_tpr_sweep(images, tiles, classes, k: int = 10, targets=(0.80, 0.90, 0.95)) -> DataFrame:
    """(k_star, target, fpr) of the kNN score."""
    s = openset_scores(images, tiles, classes, (), k).where("key = 'knn'")
    return M.fpr_at_tpr(durable(s), ["k_star"], targets, label="unknown")


def fold_summary(folds: DataFrame, metrics: Sequence[str] = ("auroc", "aupr", "fpr95")) -> DataFrame:
    """(key, metric, mean, std, n) over the folds where a metric is defined."""
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return M.mean_std(folds.select("key", F.explode(entries).alias("e")).select("key", "e.*"), ["key", "metric"])


# ---- open-world variants ---------------------------------------------------------


def unit_unknown_scores(
    units: DataFrame, models: dict[int, PrototypeModel], pool: DataFrame, excludes, knn_k: int, energy_t: float
) -> DataFrame:
    """(fold, image_id, tile_idx, residual, neg_max, energy, knn, best), best in catalog order."""
    names = ["residual", "neg_max", f"energy@{energy_t}", "best"]
    s = S.score_models(units, models, names, ("image_id", "tile_idx"))
    kept = F.create_map(*[x for f, m in models.items() for x in (F.lit(f), F.array(*[F.lit(k) for k in m.config["kept"]]))])
    s = s.withColumn("best", kept[F.col("fold")][F.col("best")]).withColumnRenamed(f"energy@{energy_t}", "energy")
    d = KNN.knn_distance(units, pool, knn_k, ("image_id", "tile_idx"), excludes)
    return s.join(d, ["fold", "image_id", "tile_idx"])


def class_refs(val_scores: DataFrame, val: DataFrame, classes: Sequence[str], models: dict[int, PrototypeModel]) -> DataFrame:
    """(fold, best, r_residual, r_knn): lower medians over pure validation units of each
    class the fold knows."""
    at = (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("combo")) - 1).cast("int")
    pure = val.select("image_id", at.alias("k")).where("k >= 0")
    known = F.create_map(*[x for f, m in models.items() for x in (F.lit(f), F.array(*[F.lit(k) for k in m.config["kept"]]))])
    u = val_scores.join(pure, "image_id").where(F.array_contains(known[F.col("fold")], F.col("k")))
    r = M.class_references(u, classes, "residual", ["fold"]).withColumnRenamed("ref", "r_residual")
    n = M.class_references(u, classes, "knn", ["fold"]).withColumnRenamed("ref", "r_knn")
    return r.join(n, ["fold", "k"], "full").withColumnRenamed("k", "best")


def with_normalised(scores: DataFrame, refs: DataFrame) -> DataFrame:
    j = scores.join(F.broadcast(refs), ["fold", "best"], "left")
    norm = lambda c: (F.col(c) / F.coalesce(f"r_{c}", F.lit(1.0))).alias(f"{c}_norm")
    return j.select("fold", "image_id", "tile_idx", "residual", "neg_max", "energy", "knn", norm("residual"), norm("knn"))


def openworld_variants(
    images: DataFrame, units: DataFrame, classes: Sequence[str], knn_k: int = 10, energy_t: float = 0.1,
    aggs: Sequence[str] = S.AGGREGATIONS, inner: bool = True,
) -> DataFrame:
    """(stage, k_star, k_in, variant, auroc, aupr, fpr95) of 6 scores x aggregations.

    `outer` folds test each class as unknown on the test split; `inner` folds, on
    validation images without it, treat every other class as unknown in turn.
    """
    k = len(classes)
    images = durable(images.select("image_id", "combo", "label", "split"))
    train = images.where("split = 'train'")
    pool = durable(units.join(train.select("image_id", "label"), "image_id"))
    val = images.where("split = 'val'")
    val_units = _of_split(units, images, "val")
    out = None
    plans = [("outer", [[s] for s in range(k)])]
    if inner:
        plans.append(("inner", [[s, i] for s in range(k) for i in range(k) if i != s]))
    # validation units meet the pool once for the folds of both stages
    every = [e for _, excludes in plans for e in excludes]
    all_models = fold_models(units, train, classes, every)
    all_vs, first = durable(unit_unknown_scores(val_units, all_models, pool, every, knn_k, energy_t)), 0
    for stage, excludes in plans:
        models = {f: all_models[first + f] for f in range(len(excludes))}
        vs = all_vs.withColumn("fold", F.col("fold") - first).where(F.col("fold").between(0, len(excludes) - 1))
        first += len(excludes)
        refs = class_refs(vs, val, classes, models)
        if stage == "outer":
            rows, target = unit_unknown_scores(_of_split(units, images, "test"), models, pool, excludes, knn_k, energy_t), images.where("split = 'test'")
        else:
            rows, target = vs, val
        vec = with_normalised(rows, refs).select("fold", "image_id", F.array(*SCORES).alias("v"))
        vec = durable(vec)
        parts = [S.aggregate_tiles(vec, len(SCORES), a, "v", ("fold", "image_id")).withColumn("agg", F.lit(a)) for a in aggs]
        long = reduce(DataFrame.unionByName, parts).select("fold", "image_id", "agg", F.posexplode("scores").alias("i", "score"))
        names = F.array(*[F.lit(n) for n in SCORES])
        long = long.withColumn("variant", F.concat_ws("/", names[F.col("i")], "agg"))
        gone = F.create_map(*[x for f, e in enumerate(excludes) for x in (F.lit(f), F.array(*[F.lit(c) for c in e]))])
        long = long.withColumn("gone", gone[F.col("fold")]).join(target.select("image_id", "label"), "image_id")
        unknown = F.element_at("label", F.element_at("gone", -1) + 1)
        if stage == "inner":
            long = long.where(F.element_at("label", F.col("gone")[0] + 1) == 0)
        long = durable(long.select("fold", "variant", "score", unknown.alias("unknown")))
        m = M.openset_metrics(long, ["fold", "variant"]).withColumn("_gone", gone[F.col("fold")]).select(
            F.lit(stage).alias("stage"),
            F.col("_gone")[0].alias("k_star"),
            F.when(F.size("_gone") > 1, F.get("_gone", F.lit(1))).alias("k_in"),
            "variant", "auroc", "aupr", "fpr95",
        )
        out = m if out is None else out.unionByName(m)
    return out


def select_variant(table: DataFrame) -> DataFrame:
    """Variants ranked by mean inner AUROC, with mean and deviation of the outer AUROC."""
    inner = M.mean_std(table.where("stage = 'inner'").withColumnRenamed("auroc", "value"), ["variant"])
    outer = M.mean_std(table.where("stage = 'outer'").withColumnRenamed("auroc", "value"), ["variant"])
    both = inner.select("variant", F.col("mean").alias("inner_auroc")).join(
        outer.select("variant", F.col("mean").alias("test_auroc"), F.col("std").alias("test_std")), "variant"
    )
    return M.leaderboard(both, "inner_auroc", "variant")


# ---- discovery -------------------------------------------------------------------


def discovery_gates(val_scores: DataFrame, q: float = 0.95, absolute: float = 0.15) -> DataFrame:
    """(fold, gate, column, threshold): the absolute residual gate and the q-quantile of
    validation units for residual, residual_norm, knn and knn_norm."""
    names = ("residual", "residual_norm", "knn", "knn_norm")
    long = _melt(val_scores, ["fold"], [n for n in names if n in val_scores.columns])
    quant = exact_quantiles(long, ["fold", "key"], "score", [q]).select(
        "fold", F.concat("key", F.lit(f"_q{int(q * 100)}")).alias("gate"), F.col("key").alias("column"), F.col("score").alias("threshold")
    )
    fixed = val_scores.select("fold").distinct().select(
        "fold", F.lit(f"residual_abs{absolute}").alias("gate"), F.lit("residual").alias("column"), F.lit(absolute).alias("threshold")
    )
    return fixed.unionByName(quant)


def discover_loso(
    images: DataFrame, tiles: DataFrame, classes: Sequence[str], gates: Sequence[float] = (0.15,), q: float = 0.05,
    min_units: int = 5, method: str = "sinkhorn", k_new: int = 1, refine=None, refine_steps: int | None = None, **propose_args,
) -> DataFrame:
    """(k_star, gate, n_flagged, recall, purity, cluster_accuracy, drift columns).

    Balanced clustering with one cluster is the normalised mean of the flagged features,
    so all folds and gates are proposed by a single pass. `refine` may be "uno", "simgcd" or
    "kd": proposals of all folds and gates are then refined together (`refine_steps` passes).
    Greedy clustering, and a function as `refine`, run per fold.
    """
    excludes = [[k] for k in range(len(classes))]
    known = fold_models(tiles, images.where("split = 'train'"), classes, excludes)
    test_tiles = _of_split(tiles, images, "test")
    together = refine if isinstance(refine, str) else None
    flagged, new = _proposals(test_tiles, known, gates, method, k_new, min_units, None if together else refine, propose_args)
    if together:
        new = _refined(images, tiles, test_tiles, classes, known, gates, new, together, refine_steps)
    gate_of = F.array(*[F.lit(float(g)) for g in gates])
    out = _discovery_report(images, tiles, classes, known, new, flagged, len(gates), q)
    return out.withColumn("gate", gate_of[F.col("g")])


def _discovery_report(images, tiles, classes, known, new, flagged, n_gate: int, q: float) -> DataFrame:
    """(k_star, g, n_flagged, discovery metrics, drift) of given proposals per fold and gate."""
    test = images.where("split = 'test'")
    test_tiles = _of_split(tiles, images, "test")
    full = {f * n_gate + g: known[f].appended(new[f, g]) for f in known for g in range(n_gate)}
    # arg-max over known and proposed prototypes; shorter models are padded to one width
    k_max = max(m.k for m in full.values())
    pad = lambda m: PrototypeModel(m.classes + ("",) * (k_max - m.k), np.vstack([m.matrix, np.zeros((k_max - m.k, m.dim))]), tau=m.tau)
    sizes = F.create_map(*[x for c, m in full.items() for x in (F.lit(c), F.lit(m.k))])
    sims = S.score_models(test_tiles, {c: pad(m) for c, m in full.items()}, ("sims",), ("image_id",), "cell")
    mean = S.tile_mean(sims, k_max, "sims", ("cell", "image_id"))
    from tessella.functions.vectors import best_class

    real = F.slice("scores", F.lit(1), sizes[F.col("cell")])
    assigned = mean.join(test.select("image_id", "label"), "image_id").select(
        F.floor(F.col("cell") / n_gate).cast("int").alias("k_star"), (F.col("cell") % n_gate).alias("g"), best_class(real).alias("best"), "label"
    )
    assigned = assigned.withColumn("unknown", F.element_at("label", F.col("k_star") + 1))
    found = CL.discovery_metrics(assigned, len(classes) - 1, ["k_star", "g"])
    moved = drift(tiles, images, classes, known, full, n_gate, q)
    out = found.join(moved, ["k_star", "g"]).join(flagged, ["k_star", "g"], "left")
    return out.withColumn("n_flagged", F.coalesce("n_flagged", F.lit(0)))


def openworld_discovery(
    images: DataFrame, units: DataFrame, classes: Sequence[str], knn_k: int = 10, energy_t: float = 0.1,
    gate_q: float = 0.95, absolute: float = 0.15, q: float = 0.05, min_units: int = 5,
) -> DataFrame:
    """Discovery with calibrated gates: (k_star, gate, n_flagged, metrics, drift).

    Gates are the absolute residual and, for residual and kNN with and without class
    normalisation, the quantile of the validation units without the held-out class.
    """
    n = len(classes)
    excludes = [[k] for k in range(n)]
    train, val = images.where("split = 'train'"), images.where("split = 'val'")
    pool = units.join(train.select("image_id", "label"), "image_id")
    known = fold_models(units, train, classes, excludes)
    score = lambda split: durable(unit_unknown_scores(_of_split(units, images, split), known, pool, excludes, knn_k, energy_t))
    vs, ts = score("val"), score("test")
    refs = class_refs(vs, val, classes, known)
    label = val.select("image_id", "label")
    inside = with_normalised(vs, refs).join(label, "image_id").where(F.element_at("label", F.col("fold") + 1) == 0)
    gates = durable(discovery_gates(inside, gate_q, absolute))
    names = sorted(r["gate"] for r in gates.select("gate").distinct().collect())
    at = F.array(*[F.lit(g) for g in names])
    long = _melt(with_normalised(ts, refs), ["fold", "image_id", "tile_idx"], ["residual", "residual_norm", "knn", "knn_norm"])
    cut = F.broadcast(gates.withColumn("g", F.array_position(at, F.col("gate")).cast("int") - 1))
    hit = long.join(cut.withColumnRenamed("column", "key"), ["fold", "key"]).where(F.col("score") > F.col("threshold"))
    hit = hit.select(F.col("fold").alias("k_star"), "g", "image_id", "tile_idx").join(units.select("image_id", "tile_idx", "z"), ["image_id", "tile_idx"])
    sums = durable(P.add_vectors(P.partial_sums(hit, ["k_star", "g"]), ["k_star", "g"]))
    got = {(r["k_star"], r["g"]): r for r in sums.collect()}
    new = {}
    for f, m in known.items():
        for g in range(len(names)):
            r = got.get((f, g))
            enough = r is not None and r["n"] >= min_units
            new[f, g] = unit_rows(np.array(r["s"])[None, :]) if enough else np.zeros((0, m.dim))
    flagged = sums.select("k_star", "g", F.col("n").cast("bigint").alias("n_flagged"))
    out = _discovery_report(images, units, classes, known, new, flagged, len(names), q)
    return out.withColumn("gate", at[F.col("g")])


def _proposals(test_tiles, known, gates, method, k_new, min_units, refine, args):
    """(flag counts table, {(fold, gate): new rows})."""
    limit = F.array(*[F.struct(F.lit(i).alias("g"), F.lit(float(g)).alias("t")) for i, g in enumerate(gates)])
    scored = S.score_models(test_tiles, known, ("residual",), ("image_id", "tile_idx", "z"), "k_star")
    hit = scored.select("k_star", "z", "residual", F.explode(limit).alias("e")).where(F.col("residual") > F.col("e.t"))
    sums = P.add_vectors(P.partial_sums(hit.select("k_star", F.col("e.g").alias("g"), "z"), ["k_star", "g"]), ["k_star", "g"])
    sums = durable(sums)
    flagged = sums.select("k_star", "g", F.col("n").cast("bigint").alias("n_flagged"))
    got = {(r["k_star"], r["g"]): r for r in sums.collect()}
    dim = next(iter(known.values())).dim
    new, several = {}, []
    for f, model in known.items():
        for g, threshold in enumerate(gates):
            r = got.get((f, g))
            if r is None or r["n"] < max(min_units, 5 * k_new if method == "sinkhorn" else 0):
                new[f, g] = np.zeros((0, dim))
            elif method == "sinkhorn" and k_new == 1 and refine is None:
                new[f, g] = unit_rows(np.array(r["s"])[None, :])
            elif method == "sinkhorn" and refine is None:
                several.append(f * len(gates) + g)
            else:
                new[f, g] = CL.propose_prototypes(test_tiles, model, threshold, method, k_new, min_size=min_units, refine=refine, **args)
    if several:  # all folds and gates iterate together
        cell = (F.col("k_star") * len(gates) + F.col("e.g")).cast("int")
        keyed = scored.select("k_star", "image_id", "tile_idx", "z", "residual", F.explode(limit).alias("e"))
        keyed = keyed.where(F.col("residual") > F.col("e.t")).select(cell.alias("cell"), "image_id", "tile_idx", "z")
        for c, centres in CL.sinkhorn_cluster_by(keyed, "cell", several, k_new, **args).items():
            new[c // len(gates), c % len(gates)] = centres
    return flagged, new


#: Passes of each refinement unless told otherwise.
REFINE_STEPS = {"uno": 100, "simgcd": 30, "kd": 50}


def _refined(images, tiles, test_tiles, classes, known, gates, new, method: str, steps: int | None) -> dict:
    """`new` ({(fold, gate): rows}) refined for all cells at once; cells without proposals stay empty."""
    if method not in REFINE_STEPS:
        raise ValueError(f"refine must be one of {sorted(REFINE_STEPS)}")
    steps = REFINE_STEPS[method] if steps is None else steps
    open_cells = [c for c, rows in new.items() if len(rows)]
    if not open_cells:
        return new
    folds = list(known)
    cells = [(f, g) for f in folds for g in range(len(gates))]
    if method == "simgcd":
        train = images.where("split = 'train'").select("image_id", F.transform("label", lambda x: x.cast("double")).alias("label"))
        rows = _of_split(tiles, images, "train").select("image_id", "z").join(train, "image_id")
        none = F.array(*[F.lit(0.0)] * len(open_cells))
        rows = rows.select("z", "label", MF.member_of([F.element_at("label", f + 1) == 0 for f, _ in open_cells]).alias("member"), none.alias("test"))
        blank = F.array(*[F.lit(0.0)] * len(classes))
        rows = rows.unionByName(test_tiles.select("z", blank.alias("label"), none.alias("member"), F.transform(none, lambda x: F.lit(1.0)).alias("test")))
        jobs = {(f, g): MF.GcdCell(known[f], new[f, g], tuple(k for k in range(len(classes)) if k != f)) for f, g in open_cells}
        return new | MF.refine_gcd_together(rows, jobs, steps)
    rows = MF.flag_cells(test_tiles, [known[f] for f in folds], gates).withColumn("label", F.array(F.lit(0.0)))
    kept = F.array(*[F.col("member")[cells.index(c)] for c in open_cells])
    jobs = {c: MF.UnoJob(new[c]) if method == "uno" else MF.KdJob(known[c[0]], new[c]) for c in open_cells}
    return new | MF.fit_together(rows.withColumn("member", kept), jobs, steps)


def drift(
    tiles: DataFrame, images: DataFrame, classes: Sequence[str], known: dict[int, PrototypeModel],
    full: dict[int, PrototypeModel], n_gate: int, q: float = 0.05,
) -> DataFrame:
    """(k_star, g, f1_before, f1_after, drift): known-class F1 with and without the proposed
    prototypes, thresholds from the training images without the held-out class."""
    k = len(classes) - 1
    drop = F.filter("label", lambda _, i: i != F.col("k_star"))
    train = images.where("split = 'train'").select("image_id", "label")
    train_tiles = _of_split(tiles, images, "train")
    tw = S.tile_mean(S.score_models(train_tiles, known, ("weights",), ("image_id",), "k_star"), k, "weights", ("k_star", "image_id"))
    tw = tw.join(train, "image_id").where(F.element_at("label", F.col("k_star") + 1) == 0).withColumn("label", drop)
    thr = C.quantile_thresholds(durable(tw), q, C.FALLBACK_MATCH, ["k_star"])
    test = images.where("split = 'test'").select("image_id", "label")
    test_tiles = _of_split(tiles, images, "test")
    phases = {f * (n_gate + 1): m for f, m in known.items()}
    phases |= {(c // n_gate) * (n_gate + 1) + c % n_gate + 1: m for c, m in full.items()}
    w = S.score_models(test_tiles, phases, ("weights",), ("image_id",), "phase")
    w = S.tile_mean(w, k, "weights", ("phase", "image_id")).join(test, "image_id")
    w = w.withColumn("k_star", F.floor(F.col("phase") / (n_gate + 1)).cast("int")).withColumn("label", drop)
    f1 = C.apply_thresholds(w, thr, ["k_star"]).groupBy("k_star", "phase").agg(F.avg(M.sample_f1()).alias("f1"))
    f1 = f1.withColumn("g", F.col("phase") % (n_gate + 1) - 1)
    before = f1.where("g = -1").select("k_star", F.col("f1").alias("f1_before"))
    after = f1.where("g >= 0").select("k_star", "g", F.col("f1").alias("f1_after"))
    return after.join(F.broadcast(before), "k_star").withColumn("drift", F.col("f1_after") - F.col("f1_before"))
