"""Balanced clustering, leader clustering and novel-class proposals.

Iterations keep the rows distributed: the state sent to tasks is K vectors or K scaling
factors, and what comes back is one aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.kernels import to_lists, to_matrix, unit_rows
from tessella.model import PrototypeModel
from tessella.operators.prototypes import add_vectors, partial_sums, total_vectors
from tessella.session import durable

# Fixed values of the balanced clustering.
ROUNDS, INNER, EPSILON, SEED_FLOOR = 30, 3, 0.05, 1e-12
ROWS_PER_CLUSTER = 5
#: Numbers of a part of a vector that tasks add up.
PART = 4096
#: Rows of a block, and blocks of a task from which on there are more tasks than cores.
BLOCK, TASK_BLOCKS = 4096, 64


def batch_sums(df: DataFrame, cols: Sequence[str], fn: Callable[[pa.RecordBatch], np.ndarray], short: bool = False) -> np.ndarray:
    """Sum over all Arrow batches of the vector `fn(batch)` returns; empty without rows.

    Every task adds up its own batches; the per-task vectors are added by Spark, in parts of
    PART numbers so that long ones are added by several tasks. A `short` vector (tens of
    numbers) skips that shuffle and is added as tasks report.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = np.asarray(fn(b), dtype=np.float64).ravel()
                total = part if total is None else total + part
        if total is not None:
            step = len(total) if short else PART
            for i in range(0, len(total), step):
                yield pa.RecordBatch.from_arrays([pa.array([i // step], pa.int32()), to_lists(total[None, i : i + step])], names=["part", "s"])

    rows = df.select(*cols).mapInArrow(run, "part int, s array<double>")
    if short:
        return np.sum([np.array(r["s"]) for r in rows.select("s").collect()], axis=0)
    parts = sorted(total_vectors(rows, ["part"]).collect(), key=lambda r: r["part"])
    return np.concatenate([np.array(r["s"]) for r in parts]) if parts else np.zeros(0)


@dataclass(frozen=True)
class Blocks:
    """Held rows: a row of `df` has the bytes of up to BLOCK of them, a binary for each column of `kinds` (type of numbers, whether lists)."""

    df: DataFrame
    kinds: dict[str, tuple[str, bool]]
    rows: int

    def count(self) -> int:
        return self.rows

    def isEmpty(self) -> bool:
        return self.rows == 0


_NUMBERS = {T.FloatType: "f4", T.DoubleType: "f8", T.IntegerType: "i4", T.LongType: "i8"}


@contextmanager
def held_blocks(df: DataFrame, cols: Sequence[str]):
    """The columns of `df`, numbers or lists of one length, for many passes: as blocks, so that a pass
    sends bytes and converts no numbers, and dealt over all cores, however few tasks `df` has."""
    kinds = {}
    for c in cols:
        kind = df.schema[c].dataType
        listed = isinstance(kind, T.ArrayType)
        kinds[c] = (_NUMBERS.get(type(kind.elementType if listed else kind), "f8"), listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                out = [pa.array([part.num_rows], pa.int64())]
                for c, (kind, listed) in kinds.items():
                    values = part.column(c).flatten() if listed else part.column(c)
                    out.append(pa.array([values.to_numpy(zero_copy_only=False).astype(kind).tobytes()], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=["_rows", *kinds])

    schema = T.StructType([T.StructField("_rows", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in kinds]])
    made = df.select(*kinds).mapInArrow(run, schema).persist(StorageLevel.MEMORY_AND_DISK)
    dealt = None
    try:
        n, rows = made.agg(F.count(F.lit(1)), F.coalesce(F.sum("_rows"), F.lit(0))).first()
        tasks = max(1, min(n, max(df.sparkSession.sparkContext.defaultParallelism, n // TASK_BLOCKS)))
        dealt = made.repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)
        dealt.count()
        made.unpersist()
        yield Blocks(dealt, kinds, rows)
    finally:
        made.unpersist()
        if dealt is not None:
            dealt.unpersist()


def task_sums(df: DataFrame | Blocks, cols: Sequence[str], fn: Callable[..., np.ndarray], short: bool = False) -> np.ndarray:
    """`batch_sums` of `fn(*matrices)`, one matrix or array for each of the columns."""
    cols = list(cols)

    def of_batch(b: pa.RecordBatch) -> np.ndarray:
        return fn(*[to_matrix(b.column(c)) if pa.types.is_list(b.column(c).type) else b.column(c).to_numpy(zero_copy_only=False) for c in cols])

    if isinstance(df, DataFrame):
        return batch_sums(df, cols, of_batch, short)
    kinds = [df.kinds[c] for c in cols]

    def of_blocks(b: pa.RecordBatch) -> np.ndarray:
        total = 0.0
        for n, *held in zip(b.column("_rows").to_pylist(), *[b.column(c) for c in cols]):
            flat = [np.frombuffer(x.as_buffer(), dtype=kind) for x, (kind, _) in zip(held, kinds)]
            total = total + np.asarray(fn(*[x.reshape(n, -1).astype(np.float64) if listed else x for x, (_, listed) in zip(flat, kinds)]), dtype=np.float64).ravel()
        return total

    return batch_sums(df.df, ["_rows", *cols], of_blocks, short)


def _balance(f: np.ndarray, centres: np.ndarray, alpha: np.ndarray, eps: float) -> np.ndarray:
    """Rows of the balanced assignment for given prototype scalings; each sums to 1."""
    e = np.exp(f @ centres.T / eps) * alpha
    return e / e.sum(axis=1, keepdims=True)


def sinkhorn_scalings(rows: DataFrame | Blocks, centres: np.ndarray, iters: int = INNER, eps: float = EPSILON, vec: str = "z") -> np.ndarray:
    """The K prototype factors after `iters` rounds of (prototype, sample) normalisation.

    Sample normalisation is local to a row; prototype normalisation is one K-vector sum.
    """
    k = len(centres)
    alpha = np.ones(k)
    for it in range(iters):
        a, first = alpha, it == 0

        def mass(z, a=a, first=first):
            f = unit_rows(z)
            return np.exp(f @ centres.T / eps).sum(axis=0) if first else _balance(f, centres, a, eps).sum(axis=0)

        total = task_sums(rows, [vec], mass, short=True)
        alpha = alpha / np.maximum(total, 1e-300)
        alpha = alpha / alpha.max()
    return alpha


def sinkhorn_assign(
    rows: DataFrame, centres: np.ndarray, iters: int = INNER, eps: float = EPSILON, keep=("image_id", "tile_idx"), vec: str = "z"
) -> DataFrame:
    """(keep, q): soft assignment of every row, balanced over the prototypes."""
    from pyspark.sql import types as T

    from tessella.operators.scoring import _map_vectors

    alpha = sinkhorn_scalings(rows, centres, iters, eps, vec)
    fn = lambda z: {"q": _balance(unit_rows(z), centres, alpha, eps)}
    return _map_vectors(rows, vec, keep, {"q": T.ArrayType(T.DoubleType())}, fn)


def seed_plusplus(rows: DataFrame, k: int, seed: int, keep=("image_id", "tile_idx"), vec: str = "z") -> np.ndarray:
    """k-means++ seeds with weight (1 - best cosine)^2, one exponential race per seed:
    the row with the smallest -ln(u) / weight wins, a top-1 instead of a weighted draw."""
    from pyspark.sql import types as T

    from tessella.operators.scoring import _map_vectors

    chosen: list[np.ndarray] = []
    for i in range(k):
        c = np.array(chosen)

        def weight(z, c=c):
            f = unit_rows(z)
            gap = np.maximum(1.0 - (f @ c.T).max(axis=1), SEED_FLOOR) if len(c) else np.ones(len(f))
            return {"_w": gap**2, "_z": f}

        out = _map_vectors(rows, vec, keep, {"_w": T.DoubleType(), "_z": T.ArrayType(T.DoubleType())}, weight)
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), *keep), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        first = out.select("_z", (-F.log(u) / F.col("_w")).alias("_t")).orderBy("_t").first()
        chosen.append(np.array(first["_z"]))
    return np.array(chosen)


def sinkhorn_cluster(
    rows: DataFrame, k: int, rounds: int = ROUNDS, inner: int = INNER, eps: float = EPSILON, seed: int = 1337,
    init: np.ndarray | None = None, vec: str = "z",
) -> np.ndarray:
    """(k, D) unit centres of balanced k-means.

    With one cluster every weight is 1, so the result is the normalised mean and a single
    pass suffices.
    """
    if k == 1:
        total = add_vectors(partial_sums(rows.withColumnRenamed(vec, "z"), []), []).first()
        return unit_rows(np.array(total["s"])[None, :])
    held = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        centres = unit_rows(init if init is not None else seed_plusplus(held, k, seed, vec=vec))
        with held_blocks(held, [vec]) as data:
            for _ in range(rounds):
                alpha, c = sinkhorn_scalings(data, centres, inner, eps, vec), centres

                def moved(z, c=c, alpha=alpha):
                    f = unit_rows(z)
                    q = _balance(f, c, alpha, eps)
                    return np.concatenate([(q.T @ f).ravel(), q.sum(axis=0)])

                s = task_sums(data, [vec], moved)
                sums, mass = s[: c.size].reshape(c.shape), s[c.size :]
                centres = unit_rows(sums / (mass[:, None] + 1e-8))
        return centres
    finally:
        held.unpersist()


def sinkhorn_cluster_by(
    rows: DataFrame, group: str, groups: Sequence[int], k: int, rounds: int = ROUNDS, inner: int = INNER,
    eps: float = EPSILON, seed: int = 1337,
) -> dict[int, np.ndarray]:
    """`sinkhorn_cluster` for several row groups (folds, gates) that share every pass.

    `group` is an integer column; rows may belong to one group each. Only K vectors per
    group travel.
    """
    from pyspark.storagelevel import StorageLevel as Level

    at = {g: i for i, g in enumerate(groups)}
    held = rows.where(F.col(group).isin([int(g) for g in groups])).persist(Level.MEMORY_AND_DISK)

    def per_group(data, fn, short=False):
        """Sum of fn(index, unit rows) per group; one vector per group."""

        def run(g, z):
            f = unit_rows(z)
            parts = {}
            for value in np.unique(g):
                parts[at[int(value)]] = fn(at[int(value)], f[g == value])
            size = len(next(iter(parts.values())))
            out = np.zeros((len(groups), size))
            for i, v in parts.items():
                out[i] = v
            return out

        return task_sums(data, [group, "z"], run, short).reshape(len(groups), -1)

    try:
        centres = np.stack([
            seed_plusplus(held.where(F.col(group) == int(g)), k, seed) for g in groups
        ])
        with held_blocks(held, [group, "z"]) as data:
            for _ in range(rounds):
                alpha, c = np.ones((len(groups), k)), centres
                for it in range(inner):
                    a, first = alpha, it == 0
                    mass = lambda i, f, c=c, a=a, first=first: (
                        np.exp(f @ c[i].T / eps).sum(axis=0) if first else _balance(f, c[i], a[i], eps).sum(axis=0)
                    )
                    alpha = alpha / np.maximum(per_group(data, mass, short=True), 1e-300)
                    alpha = alpha / alpha.max(axis=1, keepdims=True)

                def moved(i, f, c=c, alpha=alpha):
                    q = _balance(f, c[i], alpha[i], eps)
                    return np.concatenate([(q.T @ f).ravel(), q.sum(axis=0)])

                s = per_group(data, moved)
                d = c.shape[2]
                sums, weight = s[:, : k * d].reshape(c.shape), s[:, k * d :]
                centres = unit_rows(sums / (weight[:, :, None] + 1e-8))
        return {g: centres[i] for g, i in at.items()}
    finally:
        held.unpersist()


def assign_clusters(rows: DataFrame, centres: np.ndarray, keep=("image_id", "tile_idx")) -> DataFrame:
    """(keep, best): nearest centre, first on ties."""
    from tessella.operators.scoring import score_tiles

    m = PrototypeModel(tuple(str(i) for i in range(len(centres))), centres)
    return score_tiles(rows, m, ("best",), keep)


# ---- leader clustering -----------------------------------------------------------

#: Bytes of vectors that travel to tasks at once, possible leaders of a window at most, and rows compared at once in a task.
LEADER_BYTES, LEADER_WINDOW, LEADER_SLICE = 32 << 20, 8192, 512
#: Seeds of the first window; the next ones are twice as large, since leaders have taken most rows by then.
FIRST_WINDOW = 512
NONE = np.iinfo(np.int64).max


def greedy_clusters(rows: DataFrame, threshold: float, min_size: int, order: str = "row_id", vec: str = "z") -> np.ndarray:
    """Greedy cosine clusters in `order`, exactly as if rows were visited one by one; the (m, D) means of their unit rows.

    The first unassigned row is a seed. It becomes a leader when at least `min_size`
    unassigned rows (itself included) are closer than `threshold`, and takes them;
    otherwise it is dropped. A row visited before a seed is either taken or dropped by
    then, so a leader only ever takes rows at or after itself, and a row belongs to the
    first leader at or before it that is close enough.

    A window of seeds is settled in a few passes, not one by one. Each pass bounds the
    followers of every open seed: from above by the rows that no earlier leader takes, from
    below by those whose first open seed it is. Seeds below `min_size` from above are
    dropped, seeds that no earlier open one can take and that have enough from below lead and
    take others of the window; the first open seed's bounds are equal, so each pass settles
    some, mostly nearly all. Windows start small, and rows that leaders before a window
    take are not compared with its seeds, so the first leaders spare most comparisons.
    The driver holds one window and the leaders since rows were last handed out, both
    within LEADER_BYTES; then the rows these take leave the table.
    """
    free = rows.select(F.col(order).cast("bigint").alias("i"), F.col(vec).alias("z"))
    free = free.persist(StorageLevel.MEMORY_AND_DISK)
    means: list[np.ndarray] = []
    lead_id, lead_z, after, window, room = np.zeros(0, np.int64), None, None, min(FIRST_WINDOW, LEADER_WINDOW), None
    try:
        while True:
            seeds = _next_seeds(free, lead_id, lead_z, threshold, after, min(window, room or window))
            if seeds is None:
                break
            ids, z = seeds
            room = max(1, min(LEADER_WINDOW, LEADER_BYTES // (8 * z.shape[1])))
            ids, z, window = ids[:room], z[:room], min(2 * window, LEADER_WINDOW)
            after, lead_z = int(ids[-1]), np.zeros((0, z.shape[1])) if lead_z is None else lead_z
            close = _close_later(z, threshold)
            while len(ids):
                leads, still = _settled(*_seed_bounds(free, lead_id, lead_z, ids, z, threshold), close, min_size)
                lead_id, lead_z = np.concatenate([lead_id, ids[leads]]), np.vstack([lead_z, z[leads]])
                ids, z, close = ids[still], z[still], close[still][:, still]
            at = np.argsort(lead_id)
            lead_id, lead_z = lead_id[at], lead_z[at]
            if len(lead_id) >= room:
                means.append(_leader_means(free, lead_id, lead_z, threshold))
                left = _not_taken(free, lead_id, lead_z, threshold, after)
                free.unpersist()
                free, lead_id, lead_z = durable(left), lead_id[:0], lead_z[:0]
        if len(lead_id):
            means.append(_leader_means(free, lead_id, lead_z, threshold))
        return np.vstack(means) if means else np.zeros((0, 0))
    finally:
        free.unpersist()


def _first_leader(f: np.ndarray, ids: np.ndarray, lead_id: np.ndarray, lead_z: np.ndarray, threshold: float) -> np.ndarray:
    """The place of the first leader that takes each row, or -1; leaders in order."""
    if not len(lead_id):
        return np.full(len(ids), -1)
    hit = (f @ lead_z.T > threshold) & (ids[:, None] >= lead_id[None, :])
    return np.where(hit.any(axis=1), hit.argmax(axis=1), -1)


def _leader_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit rows) of batches, a slice at a time."""
    for b in batches:
        ids, f = b.column(0).to_numpy(zero_copy_only=False), unit_rows(to_matrix(b.column(1))) if b.num_rows else None
        for k in range(0, b.num_rows, LEADER_SLICE):
            yield ids[k : k + LEADER_SLICE], f[k : k + LEADER_SLICE]


def _not_taken(free: DataFrame, lead_id, lead_z, threshold: float, after: int | None) -> DataFrame:
    """(i, z) of the rows beyond `after` that no leader takes, as unit rows."""

    def run(batches):
        for ids, f in _leader_batches(batches):
            ok = _first_leader(f, ids, lead_id, lead_z, threshold) < 0
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[ok]), to_lists(f[ok])], names=["i", "z"])

    return (free if after is None else free.where(F.col("i") > after)).mapInArrow(run, "i bigint, z array<double>")


def _next_seeds(free: DataFrame, lead_id, lead_z, threshold: float, after: int | None, window: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The first `window` rows beyond `after` that no leader takes; a task passes on its own first ones only."""

    def run(batches):
        ids, z, last = np.zeros(0, np.int64), None, NONE
        for own, f in _leader_batches(batches):
            ok = (_first_leader(f, own, lead_id, lead_z, threshold) < 0) & (own <= last)
            ids, z = np.concatenate([ids, own[ok]]), f[ok] if z is None else np.vstack([z, f[ok]])
            if len(ids) > window:
                first = np.argsort(ids, kind="stable")[:window]
                ids, z = ids[first], z[first]
                last = ids[-1]
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(ids), to_lists(z)], names=["i", "z"])

    beyond = free if after is None else free.where(F.col("i") > after)
    top = beyond.mapInArrow(run, "i bigint, z array<double>").orderBy("i").limit(window).toArrow()
    return (top.column(0).to_numpy(), to_matrix(top.column(1).combine_chunks())) if top.num_rows else None


def _close_later(z: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each seed could take each later one."""
    n = len(z)
    out = np.zeros((n, n), dtype=bool)
    for k in range(0, n, LEADER_SLICE):
        out[k : k + LEADER_SLICE] = (z[k : k + LEADER_SLICE] @ z.T > threshold) & (np.arange(n)[None, :] > np.arange(k, min(k + LEADER_SLICE, n))[:, None])
    return out


def _settled(upper: np.ndarray, lower: np.ndarray, close: np.ndarray, min_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which open seeds lead and which stay open. A lower bound holds when earlier open seeds come to lead: they were before it for every row it counts."""
    leads, still = np.zeros(len(upper), dtype=bool), upper >= min_size
    while True:
        new = still & (lower >= min_size) & ~close[still].any(axis=0)
        if not new.any():
            return leads, still
        leads |= new
        still &= ~new & ~close[new].any(axis=0)


def _seed_bounds(free: DataFrame, lead_id, lead_z, ids: np.ndarray, z: np.ndarray, threshold: float) -> list[np.ndarray]:
    """For each open seed: followers at most and at least."""
    n, start = len(ids), int(ids[0])
    at = np.argsort(lead_id)
    lead_id, lead_z = lead_id[at], lead_z[at]

    def count(rid, m):
        out = np.zeros((2, n))
        every = unit_rows(m)
        for k in range(0, len(rid), LEADER_SLICE):
            own, f = rid[k : k + LEADER_SLICE], every[k : k + LEADER_SLICE]
            lead = _first_leader(f, own, lead_id, lead_z, threshold)
            by = np.where(lead < 0, NONE, lead_id[lead] if len(lead_id) else NONE)
            follows = by > start  # rows led from before the first open seed follow none
            own, f, by = own[follows], f[follows], by[follows]
            hit = (f @ z.T > threshold) & (own[:, None] >= ids[None, :]) & (ids[None, :] < by[:, None])
            out[0] += hit.sum(axis=0)
            out[1] += np.bincount(hit.argmax(axis=1)[hit.any(axis=1)], minlength=n)
        return out.ravel()

    # whole numbers, which running means of tasks may leave a little under or over
    return list(np.rint(task_sums(free.where(F.col("i") >= start), ["i", "z"], count)).reshape(2, n))


def _leader_means(free: DataFrame, lead_id: np.ndarray, lead_z: np.ndarray, threshold: float) -> np.ndarray:
    m, d = lead_z.shape

    def collect(rid, raw):
        out = np.zeros((m, d + 1))
        every = unit_rows(raw)
        for k in range(0, len(rid), LEADER_SLICE):
            f = every[k : k + LEADER_SLICE]
            lead = _first_leader(f, rid[k : k + LEADER_SLICE], lead_id, lead_z, threshold)
            np.add.at(out, lead[lead >= 0], np.hstack([f, np.ones((len(f), 1))])[lead >= 0])
        return out.ravel()

    s = task_sums(free, ["i", "z"], collect).reshape(m, d + 1)
    return s[:, :d] / s[:, d:]


# ---- proposals -------------------------------------------------------------------


def gated_rows(tiles: DataFrame, model: PrototypeModel, threshold: float, keep=("image_id", "tile_idx")) -> DataFrame:
    """Tiles whose reconstruction residual exceeds the gate, with their features."""
    from tessella.operators.scoring import score_tiles

    return score_tiles(tiles, model, ("residual",), (*keep, "z")).where(F.col("residual") > threshold).select(*keep, "z")


def propose_prototypes(
    tiles: DataFrame,
    model: PrototypeModel,
    threshold: float = 0.15,
    method: str = "sinkhorn",
    k: int = 1,
    similarity: float = 0.7,
    min_size: int = 5,
    seed: int = 1337,
    refine: Callable[[DataFrame, np.ndarray], np.ndarray] | None = None,
) -> np.ndarray:
    """Unit rows for the classes the gate suggests (possibly none).

    Features, not residuals, are clustered. `refine(rows, centres)` may adjust the result.
    """
    rows = gated_rows(tiles, model, threshold)
    need = max(min_size, ROWS_PER_CLUSTER * k) if method != "greedy" else min_size
    if rows.limit(need).count() < need:
        return np.zeros((0, model.dim))
    if method == "greedy":
        keyed = rows.withColumn("row_id", F.col("image_id") * F.lit(1 << 20) + F.col("tile_idx"))
        means = greedy_clusters(keyed, similarity, min_size)
        return unit_rows(means) if len(means) else np.zeros((0, model.dim))
    centres = sinkhorn_cluster(rows, k, seed=seed)
    return refine(rows, centres) if refine else centres


def assign_images(tiles: DataFrame, model: PrototypeModel, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """(by, best, max_sim): arg-max of the tile-mean similarities."""
    from tessella.functions.vectors import best_class
    from tessella.operators.scoring import score_tiles, tile_mean

    s = tile_mean(score_tiles(tiles, model, ("sims",), keep=by), model.k, by=by)
    return s.select(*by, best_class(F.col("scores")).alias("best"), F.array_max("scores").alias("max_sim"))


def discovery_metrics(assigned: DataFrame, k_known: int, by: Sequence[str] = ()) -> DataFrame:
    """Recall, purity and cluster accuracy of the held-out images.

    Rows are (by, unknown 0/1, best); positions from `k_known` on are proposed.
    """
    held = assigned.where("unknown = 1")
    counts = held.groupBy(*by, "best").agg(F.count("*").alias("_c"))
    is_new = F.col("best") >= k_known
    out = counts.groupBy(*by).agg(
        F.sum("_c").alias("n_held"),
        F.sum(F.when(is_new, F.col("_c")).otherwise(0)).alias("_new"),
        F.max(F.when(is_new, F.col("_c")).otherwise(0)).alias("n_dominant"),
    )
    return out.select(
        *by,
        "n_held",
        "n_dominant",
        (F.col("_new") / F.col("n_held")).alias("recall"),
        F.when(F.col("_new") > 0, F.col("n_dominant") / F.col("_new")).alias("purity"),
        (F.col("n_dominant") / F.col("n_held")).alias("cluster_accuracy"),
    )
