"""Several small models fitted together: one pass over the rows a step, however many models there are.

A row says by `member`, one 0 or 1 a model, which fits it belongs to: all folds but its own, the
variants of its granularity. In a batch each model sees its rows only; the gradients of all models
travel as one vector. A model that has converged leaves the pass, the others go on. Each fit
takes the steps that it would take alone.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.kernels import sigmoid, softmax_rows, sparsemax_rows, to_lists, to_matrix, unit_rows
from tessella.model import ChannelModel, PrototypeModel
from tessella.operators.clusters import held_blocks, task_sums
from tessella.operators.fit import Adam, asymmetric_sums, bce_sums, row_uniform, through_norm, unmix_sums

Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


class Job(Protocol):
    """A model in training: `kernel` gives what tasks add up, `update` takes a step with the totals."""

    history: list[dict]

    def width(self) -> int: ...

    def kernel(self, epoch: int) -> Kernel: ...

    def update(self, totals: np.ndarray, n: float, epoch: int) -> float: ...

    def result(self): ...


@dataclass
class UnmixJob:
    """Reconstruction fit of prototypes, as `fit.fit_unmix` does it."""

    start: PrototypeModel
    absent_lambda: float = 0.0
    reduction: str = "row_sum"
    lr: float = 1e-3
    activation: str = "sparsemax"
    history: list[dict] = field(default_factory=list)

    def __post_init__(self):
        self.raw = np.array(self.start.matrix, dtype=float)
        self.tau = np.broadcast_to(np.asarray(self.start.tau, dtype=float), (len(self.raw),)).copy()
        self.scale = 1.0 if self.reduction == "row_sum" else 1.0 / self.raw.shape[1]
        self.opt = Adam(self.lr)

    def width(self) -> int:
        return 2 + self.raw.size

    def kernel(self, epoch: int) -> Kernel:
        raw, tau, scale, absent, activation = self.raw, self.tau, self.scale, self.absent_lambda, self.activation

        def sums(z, y, ids):
            err, mass, g, _, _ = unmix_sums(z, y, raw, tau, absent / scale, activation)
            return np.concatenate([[err, mass], (g * scale).ravel()])

        return sums

    def update(self, totals: np.ndarray, n: float, epoch: int) -> float:
        out = totals / n
        err, mass = out[0] * self.scale, out[1]
        loss = err + self.absent_lambda * mass
        self.history.append({"epoch": epoch, "loss": loss, "mse": err, "absent_mass": mass})
        self.raw = self.opt.step(self.raw, out[2:].reshape(self.raw.shape))
        return loss

    def result(self) -> PrototypeModel:
        return replace(self.start, matrix=unit_rows(self.raw))


@dataclass
class ChannelJob:
    """Channel-grouped heads, as `fit.fit_channel_head` does it without mixup."""

    classes: tuple[str, ...]
    dim: int
    lr: float = 1e-2
    weight_decay: float = 1e-4
    loss: str = "bce"
    drop: float = 0.5
    gammas: tuple[float, float, float] = (0.0, 4.0, 0.05)
    seed: int = 1337
    history: list[dict] = field(default_factory=list)

    def __post_init__(self):
        self.groups = len(self.classes)
        self.size = ChannelModel.width(self.dim, self.groups)
        bound = 1.0 / np.sqrt(self.size)
        first = np.random.default_rng(self.seed).uniform(-bound, bound, (self.groups, self.size))
        self.theta = np.hstack([first, np.zeros((self.groups, 1))])
        self.opt = Adam(self.lr, self.weight_decay)

    def width(self) -> int:
        return 1 + self.theta.size

    def kernel(self, epoch: int) -> Kernel:
        t, k, c, drop, loss, gammas, seed = self.theta, self.groups, self.size, self.drop, self.loss, self.gammas, self.seed * 100_003 + epoch

        def sums(z, y, ids):
            g = z.reshape(len(z), k, c)
            if drop > 0:
                g = g * (row_uniform(ids.astype(np.int64).view(np.uint64), k * c, seed) >= drop).reshape(g.shape) / (1.0 - drop)
            logits = (g * t[:, :c]).sum(axis=2) + t[:, c]
            value, d = bce_sums(logits, y) if loss == "bce" else asymmetric_sums(logits, y, *gammas)
            return np.concatenate([[value], np.hstack([np.einsum("nk,nkc->kc", d, g), d.sum(axis=0)[:, None]]).ravel()])

        return sums

    def update(self, totals: np.ndarray, n: float, epoch: int) -> float:
        out = totals / (n * self.groups)
        self.history.append({"epoch": epoch, "loss": out[0]})
        self.theta = self.opt.step(self.theta, out[1:].reshape(self.theta.shape))
        return out[0]

    def result(self) -> ChannelModel:
        return ChannelModel(tuple(self.classes), self.theta[:, : self.size], self.theta[:, self.size])


def member_of(tests: Sequence[Column]) -> Column:
    """The `member` column from one condition a model."""
    return F.array(*[F.coalesce(t, F.lit(False)).cast("double") for t in tests])


def fit_together(rows: DataFrame, jobs: dict[Hashable, Job], epochs: int = 30, tolerance: float | None = None) -> dict:
    """name -> result of every job, fitted on `rows` (image_id, tile_idx, z, label, member).

    `member` has one number for each job, in the order of `jobs`; vectors have one length. With a
    `tolerance`, a job whose loss falls by less than that share in an epoch stops there. A job
    without rows keeps its start.
    """
    names = list(jobs)
    data = rows.select("z", "label", F.xxhash64("image_id", "tile_idx").alias("row_id"), "member")
    with held_blocks(data, data.columns) as own:
        n = dict(zip(names, task_sums(own, ["member"], lambda m: m.sum(axis=0), short=True) if not own.isEmpty() else np.zeros(len(names))))
        going, last = [x for x in names if n[x] > 0], {}
        for epoch in range(epochs):
            if not going:
                break
            parts = [(names.index(x), jobs[x].kernel(epoch), jobs[x].width()) for x in going]

            def sums(z, y, ids, m, parts=parts):
                f = unit_rows(z)
                each = []
                for i, kernel, width in parts:
                    on = m[:, i] > 0
                    each.append(kernel(f, y, ids) if on.all() else kernel(f[on], y[on], ids[on]) if on.any() else np.zeros(width))
                return np.concatenate(each)

            totals, at, stopped = task_sums(own, ["z", "label", "row_id", "member"], sums), 0, []
            for x in going:
                width = jobs[x].width()
                loss = jobs[x].update(totals[at : at + width], n[x], epoch)
                at += width
                if tolerance is not None and x in last and last[x] - loss < tolerance * abs(last[x]):
                    stopped.append(x)
                last[x] = loss
            going = [x for x in going if x not in stopped]
    return {x: job.result() for x, job in jobs.items()}


def score_together(rows: DataFrame, readers: dict[int, Callable[[np.ndarray], np.ndarray]], keep: Sequence[str] = ("image_id",), vec: str = "z") -> DataFrame:
    """(cell, keep, scores): `readers[cell]` of the unit vectors, for all cells in one pass over the rows."""
    fields = [T.StructField("cell", T.IntegerType()), *[rows.schema[c] for c in keep], T.StructField("scores", T.ArrayType(T.DoubleType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            z = unit_rows(to_matrix(b.column(vec)))
            for cell, read in readers.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, cell, np.int32)), *[b.column(c) for c in keep], to_lists(read(z))], names=["cell", *keep, "scores"])

    return rows.select(*keep, vec).mapInArrow(run, T.StructType(fields))


def channel_reader(model: ChannelModel) -> Callable[[np.ndarray], np.ndarray]:
    return lambda z: sigmoid(model.logits(z))


# ---- refinement of proposals ------------------------------------------------------


def flag_cells(tiles: DataFrame, models: Sequence[PrototypeModel], gates: Sequence[float], keep: Sequence[str] = ("image_id", "tile_idx"), vec: str = "z") -> DataFrame:
    """(keep, vec, member): whether the residual under each model is over each gate, gates of a model next to each other; one pass for all."""
    fields = [*[tiles.schema[c] for c in (*keep, vec)], T.StructField("member", T.ArrayType(T.DoubleType()))]
    params = [(unit_rows(np.asarray(m.matrix, dtype=float)), m.tau) for m in models]
    limits = np.asarray(gates, dtype=float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            z = unit_rows(to_matrix(b.column(vec)))
            residual = [np.linalg.norm(z - sparsemax_rows(z @ p.T * tau) @ p, axis=1) for p, tau in params]
            member = np.hstack([r[:, None] > limits[None, :] for r in residual]).astype(float)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (*keep, vec)], to_lists(member)], names=[*keep, vec, "member"])

    return tiles.select(*keep, vec).mapInArrow(run, T.StructType(fields))


@dataclass
class UnoJob:
    """Centres refined by BCE of scaled cosine on their own hard assignment, as `fit.refine_uno` does it."""

    centres: np.ndarray
    lr: float = 1e-2
    scale: float = 10.0
    history: list[dict] = field(default_factory=list)

    def __post_init__(self):
        self.fixed = unit_rows(self.centres)
        self.raw, self.opt = np.array(self.fixed), Adam(self.lr)

    def width(self) -> int:
        return 1 + self.raw.size

    def kernel(self, epoch: int) -> Kernel:
        raw, fixed, scale = self.raw, self.fixed, self.scale

        def sums(z, y, ids):
            value, d = bce_sums(scale * z @ unit_rows(raw).T, np.eye(len(fixed))[(z @ fixed.T).argmax(axis=1)])
            return np.concatenate([[value], (scale * d.T @ z).ravel()])

        return sums

    def update(self, totals: np.ndarray, n: float, epoch: int) -> float:
        out = totals / (n * len(self.raw))
        self.history.append({"epoch": epoch, "loss": out[0]})
        self.raw = self.opt.step(self.raw, through_norm(self.raw, out[1:].reshape(self.raw.shape)))
        return out[0]

    def result(self) -> np.ndarray:
        return unit_rows(self.raw)


@dataclass
class KdJob:
    """Proposed rows moved by reconstruction and by matching the known-only weights, as `fit.refine_kd` does it.

    The match is divided by the mean gate of all rows. Gradients are linear in it, so both
    parts are added up apart and one pass gives the gate and the gradient.
    """

    known: PrototypeModel
    new: np.ndarray
    lam: float = 1.0
    lr: float = 1e-2
    history: list[dict] = field(default_factory=list)

    def __post_init__(self):
        self.raw, self.opt = np.vstack([self.known.matrix, self.new]), Adam(self.lr)

    def width(self) -> int:
        return 1 + 2 * self.raw.size

    def kernel(self, epoch: int) -> Kernel:
        raw, fixed, kk, tau, lam = self.raw, unit_rows(self.known.matrix), self.known.k, float(self.known.tau), self.lam

        def sums(z, y, ids):
            d, taus, p = z.shape[1], np.full(len(raw), tau), unit_rows(raw)
            w, teacher = sparsemax_rows(z @ p.T * tau), sparsemax_rows(z @ fixed.T * tau)

            def match(_):
                g = np.zeros_like(w)
                g[:, :kk] = 2.0 * w[:, :kk].sum(axis=1, keepdims=True) * (w[:, :kk] - teacher) * (lam * d / kk)
                return g

            plain = unmix_sums(z, None, raw, taus)[2]
            both = unmix_sums(z, None, raw, taus, extra=match)[2]
            return np.concatenate([[w[:, :kk].sum()], plain.ravel() / d, (both - plain).ravel() / d])

        return sums

    def update(self, totals: np.ndarray, n: float, epoch: int) -> float:
        gate, parts = max(totals[0] / n, 1e-8), totals[1:].reshape(2, *self.raw.shape) / n
        grad = parts[0] + parts[1] / gate
        grad[: self.known.k] = 0.0
        self.history.append({"epoch": epoch, "gate": gate})
        self.raw = self.opt.step(self.raw, grad)
        return float(np.abs(grad).max())

    def result(self) -> np.ndarray:
        return self.raw[self.known.k :]


@dataclass
class GcdCell:
    """A joint head of known classes and proposals in training, with the classes it knows."""

    known: PrototypeModel
    centres: np.ndarray
    classes: tuple[int, ...]  # places of the known classes in a label

    def __post_init__(self):
        self.head = np.vstack([self.known.matrix, self.centres])


def refine_gcd_together(
    rows: DataFrame, cells: dict[Hashable, GcdCell], epochs: int = 30, lr: float = 1e-2, w_labeled: float = 0.5,
    sk_temp: float = 0.1, ce_temp: float = 0.1, sk_iters: int = 3,
) -> dict[Hashable, np.ndarray]:
    """name -> proposals of every cell, as `fit.refine_simgcd` makes them one by one.

    `rows` holds z, label (all classes), and for each cell a 0 or 1 in `member` (labelled
    training rows) and in `test` (unlabelled rows). An epoch is a pass for each balancing step
    and one for all gradients.
    """
    names = list(cells)
    opts = {x: Adam(lr) for x in names}
    with held_blocks(rows, ["z", "label", "member", "test"]) as own:
        g = len(names)
        n = task_sums(own, ["member", "test"], lambda a, b: np.concatenate([a.sum(axis=0), b.sum(axis=0)]), short=True)
        n_train, n_test = n[:g], np.maximum(n[g:], 1)
        for _ in range(epochs):
            heads = [unit_rows(cells[x].head) for x in names]
            alphas: list[np.ndarray] = [np.ones(len(h)) for h in heads]

            def pseudo(f, i, alphas, heads=heads):
                q = softmax_rows(f @ heads[i].T / sk_temp)
                if alphas is None:
                    return q
                q = q * alphas[i]
                return q / np.maximum(q.sum(axis=1, keepdims=True), 1e-8)

            for it in range(sk_iters):
                now = None if it == 0 else alphas

                def mass(z, te, now=now):
                    f = unit_rows(z)
                    return np.concatenate([pseudo(f[te[:, i] > 0], i, now).sum(axis=0) for i in range(g)])

                total, at = task_sums(own, ["z", "test"], mass, short=True), 0
                for i, h in enumerate(heads):
                    alphas[i] = alphas[i] / np.maximum(total[at : at + len(h)], 1e-8)
                    alphas[i] = alphas[i] / alphas[i].max()
                    at += len(h)
            kinds = [(np.array(cells[x].classes), cells[x].known.k) for x in names]

            def gradients(z, y, tr, te, alphas=alphas, heads=heads):
                f, each = unit_rows(z), []
                for i, (columns, kk) in enumerate(kinds):
                    a, b = f[tr[:, i] > 0], f[te[:, i] > 0]
                    _, d = bce_sums(a @ heads[i][:kk].T / ce_temp, y[tr[:, i] > 0][:, columns])
                    s = np.vstack([d.T @ a, np.zeros((len(heads[i]) - kk, f.shape[1]))]) / ce_temp
                    u = (softmax_rows(b @ heads[i].T / ce_temp) - pseudo(b, i, alphas)).T @ b / ce_temp
                    each.append(w_labeled * s / max(n_train[i] * kk, 1) + (1 - w_labeled) * u / n_test[i])
                return np.concatenate([x.ravel() for x in each])

            total, at = task_sums(own, ["z", "label", "member", "test"], gradients), 0
            for i, x in enumerate(names):
                head = cells[x].head
                cells[x].head = opts[x].step(head, through_norm(head, total[at : at + head.size].reshape(head.shape)))
                at += head.size
    return {x: unit_rows(c.head[c.known.k :]) for x, c in cells.items()}
