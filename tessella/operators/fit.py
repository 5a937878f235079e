"""Fitting of small models by full-batch gradient steps.

`repeat: send the parameters, sum loss and gradient over all rows, step on the driver`.
Only K x D numbers move; the rows stay where they are, persisted for the length of a
fit. Mini-batch trajectories differ by design, the losses and their optimum are the
contract.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.kernels import sigmoid, softmax_rows, sparsemax_rows, unit_rows
from tessella.model import ChannelModel, LinearModel, PrototypeModel
from tessella.operators import bags
from tessella.operators.clusters import held_blocks, task_sums
from tessella.operators.splits import mixup_pairs

FLOOR = 1e-6


@contextmanager
def held(df: DataFrame):
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


@dataclass
class Adam:
    lr: float
    weight_decay: float = 0.0  # decoupled
    m: np.ndarray | None = None
    v: np.ndarray | None = None
    t: int = 0

    def step(self, theta: np.ndarray, grad: np.ndarray) -> np.ndarray:
        if self.m is None:
            self.m, self.v = np.zeros_like(theta), np.zeros_like(theta)
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        m, v = self.m / (1 - 0.9**self.t), self.v / (1 - 0.999**self.t)
        return theta * (1 - self.lr * self.weight_decay) - self.lr * m / (np.sqrt(v) + 1e-8)


@dataclass
class Momentum:
    """SGD with Nesterov momentum; `lr` may be an array, one rate per parameter row."""

    lr: float | np.ndarray
    weight_decay: float = 0.0
    mu: float = 0.9
    buf: np.ndarray | None = None

    def step(self, theta: np.ndarray, grad: np.ndarray) -> np.ndarray:
        g = grad + self.weight_decay * theta
        self.buf = g if self.buf is None else self.mu * self.buf + g
        return theta - self.lr * (g + self.mu * self.buf)


# ---- gradients (pure functions, shared by tasks and tests) -----------------------


def through_norm(raw: np.ndarray, grad_unit: np.ndarray) -> np.ndarray:
    """Gradient with respect to raw rows, given that of their unit rows."""
    n = np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)
    u = raw / n
    return (grad_unit - (grad_unit * u).sum(axis=1, keepdims=True) * u) / n


def through_sparsemax(w: np.ndarray, grad_w: np.ndarray) -> np.ndarray:
    on = w > 0
    mean = (grad_w * on).sum(axis=1, keepdims=True) / on.sum(axis=1, keepdims=True)
    return np.where(on, grad_w - mean, 0.0)


def through_softmax(w: np.ndarray, grad_w: np.ndarray) -> np.ndarray:
    return w * (grad_w - (grad_w * w).sum(axis=1, keepdims=True))


def unmix_sums(
    z: np.ndarray, y: np.ndarray | None, raw: np.ndarray, tau: np.ndarray, absent: float = 0.0, activation: str = "sparsemax",
    extra: Callable[[np.ndarray], np.ndarray] | None = None,
):
    """Un-normalised sums of one batch: (squared error, absent mass, d raw, d log tau, d z).

    `extra(w)` adds a further gradient on the weights.
    """
    p = unit_rows(raw)
    s = z @ p.T
    w = sparsemax_rows(s * tau) if activation == "sparsemax" else softmax_rows(s * tau)
    r = z - w @ p
    d_recon = -2.0 * r
    d_w = d_recon @ p.T
    mass = 0.0
    if y is not None:
        mass = float((w * (1.0 - y)).sum())
        d_w = d_w + absent * (1.0 - y)
    if extra is not None:
        d_w = d_w + extra(w)
    back = through_sparsemax if activation == "sparsemax" else through_softmax
    d_logit = back(w, d_w)
    d_s = d_logit * tau
    d_p = w.T @ d_recon + d_s.T @ z
    d_z = 2.0 * r + d_s @ p
    return float((r * r).sum()), mass, through_norm(raw, d_p), (d_logit * s).sum(axis=0) * tau, d_z


def repulsion(raw: np.ndarray, tau_r: float) -> tuple[float, np.ndarray]:
    """mean over pairs of exp(cosine / tau_r), and its gradient."""
    p, k = unit_rows(raw), len(raw)
    e = np.exp(p @ p.T / tau_r) * (1.0 - np.eye(k))
    pairs = max(k * (k - 1), 1)
    return float(e.sum() / pairs), through_norm(raw, (2.0 / (tau_r * pairs)) * e @ p)


def bce_sums(logits: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    loss = np.maximum(logits, 0) - logits * y + np.log1p(np.exp(-np.abs(logits)))
    return float(loss.sum()), sigmoid(logits) - y


def asymmetric_sums(
    logits: np.ndarray, y: np.ndarray, gamma_pos: float, gamma_neg: float, clip: float
) -> tuple[float, np.ndarray]:
    """Asymmetric multi-label loss and its gradient: down-weighted easy negatives."""
    p = sigmoid(logits)
    q, pc = np.maximum(1 - p, FLOOR), np.maximum(p, FLOOR)
    shift = np.maximum(p - clip, 0.0)
    sc, rest = np.maximum(shift, FLOOR), np.maximum(1 - shift, FLOOR)
    pos, neg = -(q**gamma_pos) * np.log(pc), -(sc**gamma_neg) * np.log(rest)
    d_pos = np.where(1 - p > FLOOR, gamma_pos * q ** (gamma_pos - 1) * np.log(pc), 0.0) - np.where(p > FLOOR, q**gamma_pos / pc, 0.0)
    d_neg = -np.where(shift > FLOOR, gamma_neg * sc ** (gamma_neg - 1) * np.log(rest), 0.0) + np.where(
        1 - shift > FLOOR, sc**gamma_neg / rest, 0.0
    ) * (p > clip)
    d_p = np.where(y == 1, d_pos, d_neg)
    return float(np.where(y == 1, pos, neg).sum()), d_p * p * (1 - p)


def row_uniform(ids: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Uniforms in [0, 1) per (row id, column), independent of batch order."""
    x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(width, dtype=np.uint64) + np.uint64(seed * 0xBF58476D1CE4E5B9 % (1 << 64))
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mult)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


# ---- unmixing --------------------------------------------------------------------


@dataclass(frozen=True)
class UnmixFit:
    model: PrototypeModel
    history: list[dict] = field(default_factory=list)


def fit_unmix(
    tiles: DataFrame,
    start: PrototypeModel,
    epochs: int = 30,
    lr: float = 1e-3,
    reduction: str = "row_sum",
    absent_lambda: float = 0.0,
    repulsion_lambda: float = 0.0,
    tau_r: float = 0.1,
    learn_tau: bool = False,
    activation: str = "sparsemax",
    discover_every: int = 0,
    discover: Callable[[DataFrame, PrototypeModel], np.ndarray] | None = None,
) -> UnmixFit:
    """Reconstruction fit of the prototypes.

    `reduction` is "row_sum" (squared error summed over D, averaged over rows) or
    "element_mean". With a `label` column on the tiles, `absent_lambda` penalises weight
    on classes the image does not have. `learn_tau` fits one log temperature per class.
    Every `discover_every` epochs `discover(tiles, model)` may append prototypes.
    """
    labelled = "label" in tiles.columns
    cols = ["z"] + (["label"] if labelled else [])
    raw = np.array(start.matrix, dtype=float)
    log_tau = np.log(np.broadcast_to(np.asarray(start.tau, dtype=float), (len(raw),))).copy()
    model, history = start, []
    opt, opt_tau = Adam(lr), Adam(lr)
    with held(tiles) if discover else nullcontext(tiles) as rows, held_blocks(rows, cols) as data:
        n = data.count()
        for epoch in range(epochs):
            theta, tau = raw, np.exp(log_tau)
            d = theta.shape[1]
            scale = 1.0 if reduction == "row_sum" else 1.0 / d

            def sums(z, y=None, theta=theta, tau=tau, scale=scale):
                if y is not None and y.shape[1] < len(theta):  # appended prototypes carry no label
                    y = np.hstack([y, np.ones((len(y), len(theta) - y.shape[1]))])
                # the penalty is per row whatever the reduction of the error
                err, mass, g, gt, _ = unmix_sums(unit_rows(z), y, theta, tau, absent_lambda / scale, activation)
                return np.concatenate([[err, mass], (g * scale).ravel(), gt * scale])

            out = task_sums(data, cols, sums) / n
            err, mass = out[0] * scale, out[1]
            grad = out[2 : 2 + theta.size].reshape(theta.shape)
            loss = err + absent_lambda * mass
            if repulsion_lambda:
                rep, g = repulsion(theta, tau_r)
                loss, grad = loss + repulsion_lambda * rep, grad + repulsion_lambda * g
            history.append({"epoch": epoch, "loss": loss, "mse": err, "absent_mass": mass})
            raw = opt.step(theta, grad)
            if learn_tau:
                log_tau = opt_tau.step(log_tau, out[2 + theta.size :])
            model = replace(
                model,
                matrix=unit_rows(raw),
                tau=np.exp(log_tau) if learn_tau else start.tau,
            )
            if discover_every and discover and (epoch + 1) % discover_every == 0:
                new = discover(rows, model)
                if len(new):
                    model = model.appended(unit_rows(new), f"epoch{epoch + 1}_")
                    raw = np.vstack([raw, unit_rows(new)])
                    log_tau = np.concatenate([log_tau, np.full(len(new), log_tau.mean())])
                    opt, opt_tau = Adam(lr), Adam(lr)
                    if learn_tau or np.ndim(start.tau):
                        model = replace(model, tau=np.exp(log_tau))
    return UnmixFit(model, history)


@dataclass(frozen=True)
class SubspaceFit:
    w: np.ndarray  # (d, D), orthonormal rows
    model: PrototypeModel  # (K, d) prototypes in the subspace
    history: list[dict]


def subspace_sums(z, y, w, q_raw, tau, absent):
    y_raw = z @ w.T
    zp = unit_rows(y_raw)
    err, mass, d_q, _, d_zp = unmix_sums(zp, y, q_raw, tau, absent)
    return err, mass, through_norm(y_raw, d_zp).T @ z, d_q


def fit_subspace(
    tiles: DataFrame, start: PrototypeModel, w0: np.ndarray, epochs: int = 30, lr: float = 1e-3, absent_lambda: float = 0.0
) -> SubspaceFit:
    """Orthonormal projection (d, D) and prototypes in it, by alternating Adam steps and
    a QR retraction that keeps the rows orthonormal."""
    cols = ["z"] + (["label"] if "label" in tiles.columns else [])
    w = np.array(w0)
    q = unit_rows(start.matrix @ w.T)
    tau = np.broadcast_to(np.asarray(start.tau, dtype=float), (len(q),))
    opt_w, opt_q, history = Adam(lr), Adam(lr), []
    with held_blocks(tiles, cols) as rows:
        n = rows.count()
        for epoch in range(epochs):
            cw, cq = w, q

            def sums(z, y=None, cw=cw, cq=cq):
                err, mass, gw, gq = subspace_sums(unit_rows(z), y, cw, cq, tau, absent_lambda)
                return np.concatenate([[err, mass], gw.ravel(), gq.ravel()])

            out = task_sums(rows, cols, sums) / n
            history.append({"epoch": epoch, "loss": out[0] + absent_lambda * out[1], "mse": out[0], "absent_mass": out[1]})
            w = opt_w.step(cw, out[2 : 2 + cw.size].reshape(cw.shape))
            basis, r = np.linalg.qr(w.T)
            w = (basis * np.sign(np.diag(r))).T
            q = opt_q.step(cq, out[2 + cw.size :].reshape(cq.shape))
    return SubspaceFit(w, replace(start, matrix=unit_rows(q)), history)


# ---- heads -----------------------------------------------------------------------


def fit_channel_head(
    tiles: DataFrame,
    classes: Sequence[str],
    epochs: int = 30,
    lr: float = 1e-2,
    weight_decay: float = 1e-4,
    loss: str = "bce",
    drop: float = 0.5,
    mixup_alpha: float = 0.0,
    gamma_pos: float = 0.0,
    gamma_neg: float = 4.0,
    clip: float = 0.05,
    seed: int = 1337,
) -> tuple[ChannelModel, list[dict]]:
    """Channel-grouped heads on tiles with `label`.

    Channel dropout draws its mask from the row identity and the epoch, so the result does
    not depend on how rows are distributed.
    """
    k = len(classes)
    dim = tiles.select(F.size("z")).first()[0]
    width = ChannelModel.width(dim, k)
    rng = np.random.default_rng(seed)
    bound = 1.0 / np.sqrt(width)
    theta = np.hstack([rng.uniform(-bound, bound, (k, width)), np.zeros((k, 1))])
    opt, history = Adam(lr, weight_decay), []
    with held(tiles.withColumn("row_id", F.xxhash64("image_id", "tile_idx"))) as rows:
        n = rows.count()
        for epoch in range(epochs):
            data, cols = rows, ["z", "label", "row_id"]
            if mixup_alpha > 0:
                data, cols = mixup_pairs(rows, seed + epoch, mixup_alpha), [*cols, "lam", "_z", "_y"]
            t, step_seed = theta, seed * 100_003 + epoch

            def sums(z, y, ids, *mixed, t=t, step_seed=step_seed):
                if mixed:
                    lam, z2, y2 = mixed
                    z, y = z * lam[:, None] + z2 * (1.0 - lam[:, None]), np.maximum(y, y2)
                else:
                    z = unit_rows(z)
                g = z.reshape(len(z), k, width)
                if drop > 0:
                    keep = row_uniform(ids.astype(np.int64).view(np.uint64), k * width, step_seed) >= drop
                    g = g * keep.reshape(g.shape) / (1.0 - drop)
                logits = (g * t[:, :width]).sum(axis=2) + t[:, width]
                if loss == "bce":
                    value, d = bce_sums(logits, y)
                else:
                    value, d = asymmetric_sums(logits, y, gamma_pos, gamma_neg, clip)
                grad = np.hstack([np.einsum("nk,nkc->kc", d, g), d.sum(axis=0)[:, None]])
                return np.concatenate([[value], grad.ravel()])

            out = task_sums(data, cols, sums) / (n * k)
            history.append({"epoch": epoch, "loss": out[0]})
            theta = opt.step(theta, out[1:].reshape(theta.shape))
    return ChannelModel(tuple(classes), theta[:, :width], theta[:, width]), history


def fit_linear_probe(
    tiles: DataFrame,
    classes: Sequence[str],
    validation: Callable[[LinearModel], float],
    lr_grid: Sequence[float] = (1e-2, 1e-1, 1.0),
    epochs: int = 30,
    weight_decay: float = 0.0,
    seed: int = 1337,
) -> tuple[LinearModel, float, float]:
    """BCE linear heads for every learning rate at once (one data pass per step), the best
    one by `validation(model)`. Returns (model, lr, score)."""
    k, grid = len(classes), len(lr_grid)
    dim = tiles.select(F.size("z")).first()[0]
    rng = np.random.default_rng(seed)
    bound = 1.0 / np.sqrt(dim)
    one = rng.uniform(-bound, bound, (k, dim + 1))
    theta = np.vstack([one] * grid)
    opt = Momentum(np.repeat(np.asarray(lr_grid, dtype=float), k)[:, None], weight_decay)
    with held_blocks(tiles, ["z", "label"]) as rows:
        n = rows.count()
        for _ in range(epochs):
            t = theta

            def sums(z, y, t=t):
                x = np.hstack([unit_rows(z), np.ones((len(z), 1))])
                value, d = bce_sums(x @ t.T, np.tile(y, (1, grid)))
                return np.concatenate([[value], (d.T @ x).ravel()])

            out = task_sums(rows, ["z", "label"], sums) / (n * k)
            theta = opt.step(theta, out[1:].reshape(theta.shape))
    best = (None, None, -1.0)
    for g, lr in enumerate(lr_grid):
        part = theta[g * k : (g + 1) * k]
        m = LinearModel(tuple(classes), part[:, :dim], part[:, dim])
        score = validation(m)
        if score > best[2]:
            best = (m, float(lr), score)
    return best


# ---- gated attention over tiles ---------------------------------------------------


@dataclass(frozen=True)
class AttentionModel:
    classes: tuple[str, ...]
    v: np.ndarray  # (L, D)
    u: np.ndarray  # (L, D)
    w: np.ndarray  # (L,)
    weight: np.ndarray  # (K, D)
    bias: np.ndarray
    thresholds: tuple[float, ...] | None = None

    def energy(self, z: np.ndarray) -> np.ndarray:
        return (np.tanh(z @ self.v.T) * sigmoid(z @ self.u.T)) @ self.w

    def shift(self) -> float:
        """|energy| never exceeds this, so exp(energy - shift) needs no per-image maximum."""
        return float(np.abs(self.w).sum())


def attention_pool(tiles: DataFrame, model: AttentionModel, keep=("image_id",)) -> DataFrame:
    """(image_id, bag, mass): attention-weighted mean of the tile vectors.

    The softmax over an image is a ratio of sums, so one weighted mean with partial
    aggregation replaces a per-image maximum, sum and gather.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    from pyspark.sql import types as T

    from tessella.operators.scoring import _map_vectors

    fn = lambda z: {"zn": unit_rows(z), "a": np.exp(model.energy(unit_rows(z)) - model.shift())}
    rows = _map_vectors(tiles, "z", keep, {"zn": T.ArrayType(T.DoubleType()), "a": T.DoubleType()}, fn)
    pooled = rows.groupBy(*keep).agg(
        Summarizer.mean(array_to_vector("zn"), F.col("a")).alias("m"), F.sum("a").alias("mass")
    )
    return pooled.select(*keep, vector_to_array("m").alias("bag"), "mass")


def score_attention(tiles: DataFrame, model: AttentionModel) -> DataFrame:
    """(image_id, scores): sigmoid of the linear head on the pooled vector."""
    from pyspark.sql import types as T

    from tessella.operators.scoring import _map_vectors

    fn = lambda b: {"scores": sigmoid(b @ model.weight.T + model.bias)}
    return _map_vectors(attention_pool(tiles, model), "bag", ("image_id",), {"scores": T.ArrayType(T.DoubleType())}, fn)


def attention_weights(tiles: DataFrame, model: AttentionModel) -> DataFrame:
    """(image_id, tile_idx, attention): softmax of the energies within an image."""
    from pyspark.sql import types as T

    from tessella.operators.scoring import _map_vectors

    fn = lambda z: {"a": np.exp(model.energy(unit_rows(z)) - model.shift())}
    rows = _map_vectors(tiles, "z", ("image_id", "tile_idx"), {"a": T.DoubleType()}, fn)
    total = rows.groupBy("image_id").agg(F.sum("a").alias("_t"))
    return rows.join(total, "image_id").select("image_id", "tile_idx", (F.col("a") / F.col("_t")).alias("attention"))


def attention_tile_grad(z, bag, d_bag, mass, m: AttentionModel):
    """Gradient sums for V, U, w over a batch of tiles, given their image's bag gradient."""
    tv, su = np.tanh(z @ m.v.T), sigmoid(z @ m.u.T)
    a = np.exp((tv * su) @ m.w - m.shift()) / mass
    d_e = a * (d_bag * (z - bag)).sum(axis=1)
    d_w = (d_e[:, None] * tv * su).sum(axis=0)
    d_tv = d_e[:, None] * m.w * su * (1 - tv * tv)
    d_su = d_e[:, None] * m.w * tv * su * (1 - su)
    return d_tv.T @ z, d_su.T @ z, d_w


def fit_mil(
    tiles: DataFrame,
    images: DataFrame,
    classes: Sequence[str],
    hidden: int = 128,
    epochs: int = 30,
    lr: float = 1e-3,
    weight_decay: float = 1e-4,
    seed: int = 1337,
    validation: Callable[[AttentionModel], float] | None = None,
    check_every: int = 1,
) -> tuple[AttentionModel, list[dict]]:
    """Gated-attention pooling head, BCE on images; the best epoch by `validation(model)`, if given.

    Tiles become bags once, one row an image. A step is one map over the bags: pooling, head
    and the way back to the tiles stay in a row. Images in several bags take a second, small
    pass (see `operators.bags`).
    """
    k = len(classes)
    dim = tiles.select(F.size("z")).first()[0]
    rng = np.random.default_rng(seed)
    init = lambda *shape: rng.uniform(-1, 1, shape) / np.sqrt(shape[-1])
    parts = [init(hidden, dim), init(hidden, dim), init(hidden), init(k, dim), np.zeros(k)]
    opts = [Adam(lr, weight_decay) for _ in parts]
    best, best_score, history = None, -1.0, []
    labels = images.select("image_id", F.transform("label", lambda x: x.cast("double")).alias("label"))
    with held(bags.make_bags(tiles).join(labels, "image_id")) as rows:
        n, long = rows.agg(F.countDistinct("image_id"), F.coalesce(F.max(F.col("parts") > 1), F.lit(False))).first()
        for epoch in range(epochs):
            m = AttentionModel(tuple(classes), *parts)
            loss, grad = bags.split_sums(bags.epoch_sums(rows, m, n, long), hidden, dim, k)
            history.append({"epoch": epoch, "loss": loss})
            parts = [o.step(p, q) for o, p, q in zip(opts, parts, grad)]
            if validation and (epoch + 1) % check_every == 0:
                candidate = AttentionModel(tuple(classes), *parts)
                score = validation(candidate)
                history[-1]["val"] = score
                if score > best_score:
                    best, best_score = candidate, score
    return best or AttentionModel(tuple(classes), *parts), history


# ---- refinement of proposed prototypes ---------------------------------------------


def refine_uno(rows: DataFrame, centres: np.ndarray, steps: int = 100, lr: float = 1e-2, scale: float = 10.0) -> np.ndarray:
    """Centres refined by BCE of scaled cosine on their own hard assignment."""
    k, fixed = len(centres), unit_rows(centres)
    raw, opt = np.array(fixed), Adam(lr)
    with held_blocks(rows, ["z"]) as data:
        n = data.count()
        for _ in range(steps):
            t = raw

            def sums(z, t=t):
                f = unit_rows(z)
                y = np.eye(k)[(f @ fixed.T).argmax(axis=1)]
                _, d = bce_sums(scale * f @ unit_rows(t).T, y)
                return (scale * d.T @ f).ravel()

            grad = task_sums(data, ["z"], sums).reshape(t.shape) / (n * k)
            raw = opt.step(t, through_norm(t, grad))
    return unit_rows(raw)


def refine_simgcd(
    train: DataFrame, test: DataFrame, known: PrototypeModel, centres: np.ndarray, epochs: int = 30, lr: float = 1e-2,
    w_labeled: float = 0.5, sk_temp: float = 0.1, ce_temp: float = 0.1, sk_iters: int = 3,
) -> np.ndarray:
    """Novel rows of a joint head: supervised BCE on the known columns of the training
    tiles (`label` without the held-out class), cross-entropy of balanced pseudo-labels
    on the test tiles."""
    kk = known.k
    head, opt = np.vstack([known.matrix, centres]), Adam(lr)
    k = len(head)
    with held_blocks(train, ["z", "label"]) as tr, held_blocks(test, ["z"]) as te:
        n_tr, n_te = tr.count(), te.count()
        for _ in range(epochs):
            t, h = head, unit_rows(head)

            def supervised(z, y, h=h):
                f = unit_rows(z)
                _, d = bce_sums(f @ h[:kk].T / ce_temp, y)
                return np.vstack([d.T @ f / ce_temp, np.zeros((k - kk, f.shape[1]))]).ravel()

            alpha = np.ones(k)

            def pseudo(f, h, alpha):
                q = softmax_rows(f @ h.T / sk_temp) * alpha
                return q / np.maximum(q.sum(axis=1, keepdims=True), 1e-8)

            for it in range(sk_iters):
                a, first = alpha, it == 0

                def mass(z, h=h, a=a, first=first):
                    f = unit_rows(z)
                    q = softmax_rows(f @ h.T / sk_temp) if first else pseudo(f, h, a)
                    return q.sum(axis=0)

                alpha = alpha / np.maximum(task_sums(te, ["z"], mass, short=True), 1e-8)
                alpha = alpha / alpha.max()

            def unsupervised(z, h=h, alpha=alpha):
                f = unit_rows(z)
                d = softmax_rows(f @ h.T / ce_temp) - pseudo(f, h, alpha)
                return (d.T @ f / ce_temp).ravel()

            g = w_labeled * task_sums(tr, ["z", "label"], supervised) / (n_tr * kk)
            g = g + (1 - w_labeled) * task_sums(te, ["z"], unsupervised) / n_te
            head = opt.step(t, through_norm(t, g.reshape(t.shape)))
    return unit_rows(head[kk:])


def refine_kd(
    rows: DataFrame, known: PrototypeModel, new: np.ndarray, lam: float = 1.0, steps: int = 50, lr: float = 1e-2
) -> np.ndarray:
    """Proposed rows moved by reconstruction plus matching the known-only weights.

    The match is gated by the weight a row already gives the known classes, relative to
    the mean gate; the known rows stay."""
    if not len(new):
        return new
    kk, tau = known.k, known.tau
    raw, opt = np.vstack([known.matrix, new]), Adam(lr)
    fixed = unit_rows(known.matrix)
    with held_blocks(rows, ["z"]) as data:
        n = data.count()
        for _ in range(steps):
            t = raw

            def gates(z, t=t):
                w = sparsemax_rows(unit_rows(z) @ unit_rows(t).T * tau)
                return np.array([w[:, :kk].sum()])

            mean_gate = max(float(task_sums(data, ["z"], gates, short=True)[0]) / n, 1e-8)

            def sums(z, t=t, mean_gate=mean_gate):
                f = unit_rows(z)
                teacher = sparsemax_rows(f @ fixed.T * tau)
                d = f.shape[1]

                def match(w):
                    gate = w[:, :kk].sum(axis=1, keepdims=True) / mean_gate
                    g = np.zeros_like(w)
                    g[:, :kk] = 2.0 * gate * (w[:, :kk] - teacher) * (lam * d / kk)
                    return g

                return unmix_sums(f, None, t, np.full(len(t), float(tau)), extra=match)[2].ravel() / d

            grad = task_sums(data, ["z"], sums).reshape(t.shape) / n
            grad[:kk] = 0.0
            raw = opt.step(t, grad)
    return raw[kk:]


def best_checkpoint(models: DataFrame, metric: str = "val_f1", tie: str = "epoch", by: Sequence[str] = ("run_id",)) -> DataFrame:
    """The stored epoch with the best validation metric of every run (the earliest on ties)."""
    from tessella.operators.metrics import best_per

    return best_per(models, by, metric, tie)
