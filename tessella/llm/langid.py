"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its byte 3- to 5-grams inside and across word borders,
hashed into a table; a linear layer and softmax follow. Both are trained together by stochastic
gradient descent on a bounded sample of labelled rows. As the layer is linear, a trained table row
and the layer fold into one score vector per n-gram, so a text is scored in one look-up each.

A temperature is fitted on rows of the sample that were not trained on. A prediction is rejected
when its calibrated probability is below what nearly all right answers of those rows reach.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.arrow import map_texts

BUCKETS, DIM, EPOCHS, RATE, BATCH = 1 << 16, 16, 4, 3.0, 32
#: Steps at least: a small sample is gone through more often.
STEPS = 600
#: Labelled rows of each language that are trained on, about; and their bytes at most, all together.
SAMPLE, SAMPLE_BYTES = 1_200, 40_000_000
#: Share of right answers that may be rejected, and the highest threshold that may come of it.
LOST, HIGHEST = 0.001, 0.6
UNKNOWN = "und"
#: Bytes hashed at once.
BLOCK = 1 << 20


def _letters() -> np.ndarray:
    """Lower case of ASCII letters; bytes of other characters stay; the rest is a blank."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


LETTERS = _letters()


def subwords(text: str) -> np.ndarray:
    """Buckets of all 3-, 4- and 5-grams of the letters, words apart by one blank."""
    x = LETTERS[np.frombuffer(text.encode(), np.uint8)]
    blank = x == 32
    x = np.r_[np.uint8(32), x[~(blank & np.r_[True, blank[:-1]])], np.uint8(32)].astype(np.uint32)
    out = []
    with np.errstate(over="ignore"):
        h = x * np.uint32(0x01000193)
        for n in range(1, 5):
            if len(x) <= n:
                break
            h = (h[:-1] ^ x[n:]) * np.uint32(0x01000193) + np.uint32(n)
            if n >= 2:
                out.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # buckets x languages: table times layer
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, text: str) -> np.ndarray:
        """The mean over a text's n-grams, a block of text at a time; those at a border are met in both blocks."""
        total, n = np.zeros(len(self.languages)), 0
        for at in range(0, max(1, len(text)), BLOCK):
            b = subwords(text[at : at + BLOCK + 4])
            total += np.bincount(b, minlength=len(self.scores)) @ self.scores if len(b) > len(self.scores) else self.scores[b].sum(0)
            n += len(b)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, rejected)."""
        if not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        i = int(p.argmax())
        return self.languages[i], float(p[i]), bool(p[i] < self.threshold)


def _bag(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, their shares) of a text, in small numbers."""
    u, c = np.unique(buckets, return_counts=True)
    return u.astype(np.uint32), (c / len(buckets)).astype(np.float32)


def fit(rows: list[tuple[str, str]], buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, seed: int = 3) -> Model:
    """Train on (text, language) pairs; a fifth of them calibrates."""
    languages = sorted({y for _, y in rows})
    if not languages:
        return Model([UNKNOWN], np.zeros((buckets, 1), np.float32), np.zeros(1), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    known = [(*_bag(b), languages.index(y)) for x, y in rows if len(b := subwords(x))]
    order = rng.permutation(len(known))
    held, train = [known[i] for i in order[: len(known) // 5]], [known[i] for i in order[len(known) // 5 :]]
    table = rng.normal(0, 1 / dim, (buckets, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    layer += rng.normal(0, 0.1, layer.shape).astype(np.float32)
    epochs = max(epochs, -(-STEPS // -(-len(train) // BATCH))) if train else 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        shuffled = rng.permutation(len(train))
        for at in range(0, len(shuffled), BATCH):
            part = shuffled[at : at + BATCH]
            mean = np.stack([c @ table[u] for u, c, _ in (train[i] for i in part)])
            z = mean @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), [train[i][2] for i in part]] -= 1
            p /= len(part)
            back = p @ layer.T
            layer -= rate * (mean.T @ p)
            bias -= rate * p.sum(0)
            for row, i in zip(back, part):
                u, c, _ = train[i]
                table[u] -= rate * c[:, None] * row
    model = Model(languages, (table @ layer).astype(np.float32), bias.astype(np.float64), 1.0, 0.0)
    if held:
        z = np.stack([c @ model.scores[u] + model.bias for u, c, _ in held])
        y = np.array([i for _, _, i in held])
        loss = lambda t: float((np.log(np.exp((z - z.max(1, keepdims=True)) / t).sum(1)) - ((z[np.arange(len(y)), y] - z.max(1)) / t)).mean())
        model.temperature = min(np.geomspace(0.05, 5, 60), key=loss)
        p = np.exp((z - z.max(1, keepdims=True)) / model.temperature)
        p /= p.sum(1, keepdims=True)
        right = p.max(1)[p.argmax(1) == y]
        model.threshold = float(min(HIGHEST, np.quantile(right, LOST))) if len(right) else 0.0
    return model


def sample_rows(labelled: DataFrame, key: str, text: str, label: str, each: int, most_bytes: int) -> list[tuple[str, str]]:
    """About `each` whole texts of every label, by hash of key, from a first count of labels; at most `most_bytes` bytes.

    The labels of a classifier are few; more than 10,000 of them are refused.
    """
    known = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    counts = known.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("bytes")).limit(10_001).collect()
    if len(counts) > 10_000:
        raise ValueError("too many labels for a classifier")
    if not counts:
        return []
    picked = {r[label]: min(1.0, each / r["n"]) for r in counts}
    size = sum(picked[r[label]] * r["bytes"] for r in counts)
    shrink = min(1.0, most_bytes / size) if size else 1.0
    share = F.lit(0.0)
    for y, s in picked.items():
        share = F.when(F.col(label) == F.lit(y), F.lit(s * shrink)).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit(17), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows, held, size = known.where(draw < share).select(F.xxhash64(F.lit(17), key), text, label).collect(), [], 0
    for _, x, y in sorted(rows):
        size += len(x.encode())
        if held and size > 2 * most_bytes:
            break
        held.append((x, y))
    return held


def train(df: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "lang", each: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model:
    """A model of the rows where `usable` holds."""
    return fit(sample_rows(df.where(usable), key, text, label, each, most_bytes))


def identify(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (all but `text` unless given) with lang_pred, score and rejected.

    Null texts and texts without a letter are `und` with score 0 and rejected. Columns of these
    names are replaced.
    """
    def run(texts):
        return [list(x) for x in zip(*map(model.predict, texts))]

    return map_texts(df, text, "lang_pred string, score double, rejected boolean", run, keep)
