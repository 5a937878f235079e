"""Per-row vector arithmetic as plain Column expressions.

These stay inside the JVM and inside generated code. The matrix kernels in
`functions.kernels` compute the same values in Arrow batches; use those when the
number of prototypes times dimensions is large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: norm floor of the usual vector normalisation.
NORM_FLOOR = 1e-12


def _sum(values) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a, b) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(v) -> Column:
    n = F.greatest(norm(v), F.lit(NORM_FLOOR))
    return F.transform(v, lambda x: x.cast("double") / n)


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def cosine_scores(z, prototypes: Column) -> Column:
    """z against an array of unit prototypes."""
    unit = l2_normalize(z)
    return F.transform(prototypes, lambda p: dot(unit, p))


def max_score(scores) -> Column:
    return F.array_max(scores)


def best_class(scores) -> Column:
    """0-based arg-max, the first position on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def logits(scores, tau) -> Column:
    """Scores times one temperature, or element-wise times an array of them."""
    if isinstance(tau, (int, float)):
        return F.transform(scores, lambda s: s * float(tau))
    return F.zip_with(scores, tau, lambda s, t: s * t)


def sparsemax(x) -> Column:
    """Euclidean projection on the simplex, exact zeros included.

    With the values in descending order the support is the longest prefix of size r
    whose r-th value exceeds (prefix sum - 1) / r.
    """
    desc = F.sort_array(x, asc=False)
    prefix = F.transform(
        F.sequence(F.lit(1), F.size(x)),
        lambda r: F.struct(
            r.cast("double").alias("r"),
            F.element_at(desc, r).alias("v"),
            (_sum(F.slice(desc, F.lit(1), r)) - 1.0).alias("c"),
        ),
    )
    support = F.filter(prefix, lambda s: s["v"] - s["c"] / s["r"] > 0)
    last = F.element_at(support, -1)
    cut = last["c"] / last["r"]
    return F.transform(x, lambda v: F.greatest(v - cut, F.lit(0.0)))


def softmax(x) -> Column:
    top = F.array_max(x)
    exps = F.transform(x, lambda v: F.exp(v - top))
    total = _sum(exps)
    return F.transform(exps, lambda e: e / total)


def reconstruct(weights, prototypes: Column, dim: int) -> Column:
    """Weighted sum of the prototypes."""
    zero = F.array_repeat(F.lit(0.0), dim)
    scaled = F.zip_with(weights, prototypes, lambda w, p: F.transform(p, lambda v: v * w))
    return F.aggregate(scaled, zero, lambda acc, p: F.zip_with(acc, p, lambda a, b: a + b))


def residual_norm(z, weights, prototypes: Column, dim: int) -> Column:
    return norm(F.zip_with(l2_normalize(z), reconstruct(weights, prototypes, dim), lambda a, b: a - b))


def energy(scores, temperature: float) -> Column:
    """-T * logsumexp(s / T), shifted by the maximum."""
    top = F.array_max(scores)
    total = _sum(F.transform(scores, lambda s: F.exp((s - top) / temperature)))
    return -(top + F.log(total) * temperature)


def neg_max(scores) -> Column:
    return -F.array_max(scores)


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def channel_logits(z, weight: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """Class k reads its own contiguous slice of channels."""
    width = len(weight[0])
    return F.array(
        *[
            dot(F.slice(z, k * width + 1, width), vector_literal(row)) + float(bias[k])
            for k, row in enumerate(weight)
        ]
    )


def own_margin(scores, own) -> Column:
    """Own score minus the best other score; `own` is a 0-based class position."""
    others = F.filter(scores, lambda _, i: i != own)
    return F.element_at(scores, own + 1) - F.array_max(others)


def own_is_best(scores, own) -> Column:
    return best_class(scores) == own


def presence(scores, thresholds: Column, strict: bool = True) -> Column:
    """0/1 vector of score > threshold (>= when not strict)."""
    if strict:
        return F.zip_with(scores, thresholds, lambda s, t: (s > t).cast("int"))
    return F.zip_with(scores, thresholds, lambda s, t: (s >= t).cast("int"))


def presence_fixed(scores, threshold: float = 0.05) -> Column:
    """The fixed-threshold variant, which includes equality."""
    return F.transform(scores, lambda s: (s >= threshold).cast("int"))


def unknown_by_residual(residual, threshold: float = 0.15) -> Column:
    return residual > threshold


def unknown_by_similarity(max_similarity, threshold: float = 0.5) -> Column:
    return max_similarity < threshold


def combined_metric(f1, auroc, alpha: float = 0.5) -> Column:
    return f1 * alpha + auroc * (1.0 - alpha)


def is_central_tile(tile_idx, grid: int = 4) -> Column:
    """True away from the border of a row-major grid x grid layout."""
    row, col = F.floor(tile_idx / grid), tile_idx % grid
    return row.between(1, grid - 2) & col.between(1, grid - 2)
