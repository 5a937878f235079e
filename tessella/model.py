"""Fitted parameters: a few K x D numbers that travel to tasks inside a closure."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

# A model is parameters, not data. Beyond this it should be scored block by block.
MAX_PARAMETER_BYTES = 256 << 20


@dataclass(frozen=True)
class PrototypeModel:
    """Unit prototypes in class order, with an optional temperature and thresholds."""

    classes: tuple[str, ...]
    matrix: np.ndarray  # (K, D)
    source: tuple[str, ...] = ()
    tau: float | np.ndarray = 10.0
    thresholds: tuple[float | None, ...] | None = None
    unknown_threshold: float | None = None
    config: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.matrix.nbytes > MAX_PARAMETER_BYTES:
            raise ValueError("prototype matrix is larger than a closure should carry; split it by class")

    @property
    def k(self) -> int:
        return len(self.classes)

    @property
    def dim(self) -> int:
        return self.matrix.shape[1]

    def without(self, k: int) -> "PrototypeModel":
        keep = [i for i in range(self.k) if i != k]
        return replace(
            self,
            classes=tuple(self.classes[i] for i in keep),
            matrix=self.matrix[keep],
            source=tuple(self.source[i] for i in keep) if self.source else (),
            thresholds=None,
        )

    def appended(self, rows: np.ndarray, prefix: str = "new") -> "PrototypeModel":
        names = tuple(f"{prefix}{i}" for i in range(len(rows)))
        return replace(
            self,
            classes=self.classes + names,
            matrix=np.vstack([self.matrix, rows]) if len(rows) else self.matrix,
            source=(self.source or ("",) * self.k) + ("proposed",) * len(rows),
            thresholds=None,
        )


@dataclass(frozen=True)
class ChannelModel:
    """Channel-grouped linear heads: class k reads channels [k*D/K, (k+1)*D/K)."""

    classes: tuple[str, ...]
    weight: np.ndarray  # (K, D / K)
    bias: np.ndarray  # (K,)
    thresholds: tuple[float, ...] | None = None

    @property
    def k(self) -> int:
        return len(self.classes)

    @staticmethod
    def width(dim: int, k: int) -> int:
        if dim % k:
            raise ValueError(f"embedding size {dim} is not divisible by {k} classes")
        return dim // k

    def logits(self, z: np.ndarray) -> np.ndarray:
        grouped = z.reshape(len(z), self.k, self.width(z.shape[1], self.k))
        return (grouped * self.weight).sum(axis=2) + self.bias


@dataclass(frozen=True)
class LinearModel:
    classes: tuple[str, ...]
    weight: np.ndarray  # (K, D)
    bias: np.ndarray
    thresholds: tuple[float, ...] | None = None

    @property
    def k(self) -> int:
        return len(self.classes)

    def logits(self, z: np.ndarray) -> np.ndarray:
        return z @ self.weight.T + self.bias
