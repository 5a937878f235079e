"""Quality scores learned from trusted positives and unlabelled text.

No negative is needed: with the share `prior` of good text among the unlabelled, the risk on bad
text is that on unlabelled text less `prior` times that on good text. An estimate of it below
zero is overfitting; then the step goes the other way. The prior is estimated from where held
positives outnumber the unlabelled least, after a first fit of positives against unlabelled text.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.arrow import map_texts

#: Positives and unlabelled rows that are trained on, about, and their bytes at most.
POSITIVES, UNLABELLED, SAMPLE_BYTES = 5_000, 8_000, 80_000_000
HIDDEN, STEPS, BATCH, RATE, DECAY = 16, 1_500, 256, 0.01, 1e-3
CUT = 0.3

_KIND = np.zeros(256, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
for _i, _c in enumerate(b"#*$%&|<>", 1):
    _KIND[_c] = 5
for _c in b".,;:":
    _KIND[_c] = 6
for _c in b"!?":
    _KIND[_c] = 7
for _c in b"()[]{}=+/\\_@~^`\"'-":
    _KIND[_c] = 8
for _c in b" \t\r\n\x0b\x0c":
    _KIND[_c] = 9


def features(text: str | None) -> np.ndarray:
    """What a whole text looks like: its characters, words and lines, as bounded numbers."""
    raw = (text or "").encode()
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=10) if raw else np.zeros(10)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, m = max(1, len(words)), max(1, len(raw))
    first = [w[:1] for w in words]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    last = [w[-1:] for w in words]
    ends = max(map(last.count, set(last)), default=0) if len(set(last)) < 400 else 0
    return np.r_[
        kinds / m,
        np.log1p(len(raw)),
        np.log1p(len(words)),
        len(set(words)) / n,
        len(set(words)) / n**0.8,
        sum(map(eq, words, words[1:])) / n,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(len(raw) / max(1, len(lines))),
        np.log1p(lengths.mean()),
        np.log1p(lengths.std()),
        np.log1p(lengths.max()),
        sum(map(bytes.isupper, words)) / n,
        sum(map(bytes.isalpha, words)) / n,
        sum(map(bytes.isupper, first)) / n,
        ends / n,
        (kinds[5] + kinds[7]) / n,
        kinds[6] / n,
    ].astype(np.float64)


@dataclass
class Net:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    c: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.tanh(x @ self.w + self.b) @ self.v + self.c

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(x)))


def _fit(good: np.ndarray, any_: np.ndarray, prior: float | None, seed: int) -> Net:
    """With a prior: non-negative risk of positives and unlabelled rows. Without: positives against unlabelled rows."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([good, any_])
    net = Net(both.mean(0), both.std(0) + 1e-6, rng.normal(0, 0.3, (both.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), 0.0, prior or 0.5)
    scaled = lambda x: np.clip((x - net.mean) / net.scale, -4, 4)
    good, any_ = scaled(good), scaled(any_)
    params = [net.w, net.b, net.v, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        gi, ui = rng.integers(0, len(good), BATCH), rng.integers(0, len(any_), 2 * BATCH)
        x = np.concatenate([good[gi], any_[ui]])
        h = np.tanh(x @ params[0] + params[1])
        z = h @ params[2] + params[3][0]
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        soft = np.logaddexp(0, z)  # loss of calling it good when it is bad
        g = np.zeros(len(x))
        if prior is None:
            g[:BATCH], g[BATCH:] = (s[:BATCH] - 1) / BATCH, s[BATCH:] / (2 * BATCH)
        else:
            bad = soft[BATCH:].mean() - prior * soft[:BATCH].mean()
            back = np.r_[-prior * s[:BATCH] / BATCH, s[BATCH:] / (2 * BATCH)]
            if bad >= 0:
                g = back
                g[:BATCH] += prior * (s[:BATCH] - 1) / BATCH
            else:
                g = -back
        gh = np.outer(g, params[2]) * (1 - h * h)
        grads = [x.T @ gh + DECAY * params[0], gh.sum(0), h.T @ g + DECAY * params[2], np.array([g.sum()])]
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for i, d in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * d
            second[i] = 0.99 * second[i] + 0.01 * d * d
            params[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    net.w, net.b, net.v, net.c = params[0], params[1], params[2], float(params[3][0])
    return net


def estimate_prior(good: np.ndarray, any_: np.ndarray, sure: float = 0.1) -> float:
    """The share of good rows among unlabelled ones, from scores of rows not trained on.

    Above any score, unlabelled rows are at least the good ones among them: their tail over the
    positives' tail bounds the share. The bound with the smallest upper confidence limit is taken.
    """
    noise = np.sqrt(np.log(4 / sure) / 2) * (len(good) ** -0.5 + len(any_) ** -0.5)
    tails = [((good >= t).mean(), (any_ >= t).mean()) for t in np.quantile(good, np.linspace(0, 0.98, 50))]
    p, u = min(tails, key=lambda x: (x[1] + noise) / x[0])  # the bound that is surest to be small
    return float(np.clip(u / p, 0.02, 0.99))


def fit(good: np.ndarray, any_: np.ndarray, seed: int = 5) -> Net | None:
    """None where there is nothing to learn from."""
    if len(good) < 20 or len(any_) < 20:
        return None
    rng = np.random.default_rng(seed)
    good, any_ = good[rng.permutation(len(good))], any_[rng.permutation(len(any_))]
    g, u = len(good) // 2, len(any_) // 2
    tell = _fit(good[:g], any_[:u], None, seed)
    prior = estimate_prior(tell.logits(good[g:]), tell.logits(any_[u:]))
    return _fit(good, any_, prior, seed)


def sample_ids(rows: DataFrame, key: str, each: int, most_bytes: int) -> DataFrame:
    """Keys of about `each` rows (key, size) by hash of key, never more than twice as many, about `most_bytes` bytes of text."""
    n, size = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    share = min(1.0, each / max(1, n), most_bytes / max(1, size or 0))
    draw = F.pmod(F.xxhash64(F.lit(23), key), F.lit(1 << 30))
    return rows.where(draw < int(share * (1 << 30)) + 1).orderBy(draw, key).limit(2 * each).select(key)


def train(df: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", positives: int = POSITIVES, unlabelled: int = UNLABELLED, most_bytes: int = SAMPLE_BYTES) -> Net | None:
    """A model of the documents where `usable` holds: those labelled good, and those without a label. Labels of bad ones are not read.

    `labels` holds `key` and `quality`; a document with several labels is good if any says so.
    Keys are drawn first; texts are read for the drawn keys alone, and only they reach the driver.
    """
    docs = df.where(usable & F.col(text).isNotNull())
    sizes = docs.select(key, F.octet_length(text).alias("size"))
    rated = labels.where(F.col("quality").isNotNull()).groupBy(key).agg(F.max("quality").alias("q"))
    good = sample_ids(sizes.join(rated.where("q = 1").select(key), key, "left_semi"), key, positives, most_bytes // 2)
    rest = sample_ids(sizes.join(rated.select(key), key, "left_anti"), key, unlabelled, most_bytes // 2)
    drawn = good.withColumn("good", F.lit(True)).unionByName(rest.withColumn("good", F.lit(False)))
    # at most twice the two sample sizes
    rows = docs.select(key, text).join(F.broadcast(drawn), key).select(F.xxhash64(F.lit(23), key), "good", text).collect()
    x, total = {True: [], False: []}, 0
    for _, g, t in sorted(tuple(r) for r in rows):
        total += len(t.encode())
        if total > 2 * most_bytes:
            break
        x[g].append(features(t))
    return fit(*[np.array(x[g]).reshape(len(x[g]), len(features(""))) for g in (True, False)])


def score(df: DataFrame, net: Net | None, text: str = "text", keep: list[str] | None = None, cut: float = CUT) -> DataFrame:
    """`keep` columns (all but `text` unless given) with score and predicted, which replace their namesakes.

    Null and empty texts are scored by the features of an empty text. Without a model every score is 1.
    """
    def run(texts):
        s = net.score(np.array([features(t) for t in texts])) if net else np.ones(len(texts))
        return [s.tolist(), (s >= cut).astype(int).tolist()]

    return map_texts(df, text, "score double, predicted int", run, keep)
