"""Quality rules of documents and of hosts.

A document fails by what is in its text. Failures are counted by host, a host's failure rate is
shrunk towards that of all hosts with a beta prior fitted to the hosts' rates by their mean and
variance, and a host whose shrunk rate is over the limit takes all its documents with it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.arrow import map_texts
from tessella.session import durable

#: Characters that count as symbols, and the blanks between words.
SYMBOLS, BLANKS = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEATS, MAX_RATE, SALTS = 50, 0.5, 0.5, 16
#: Limits of the prior's weight, in documents; the upper one also stands where hosts do not differ.
WEIGHT = (1.0, 1000.0)


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words in windows of `window` words that are found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    run = ids[:n]
    for i in range(1, window):
        if i > 1 or len(number) > 3_000_000_000:
            run = np.unique(run, return_inverse=True)[1]
        run = run * len(number) + ids[i : i + n]
    order = np.argsort(run, kind="stable")
    same = run[order[1:]] == run[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for i in range(window):
        covered[i : i + n] |= hit
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """(words, characters in words, symbols, lines that repeat an earlier one, repeated words)."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()  # exactly the blanks above
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), len(text) - sum(map(raw.count, (BLANKS[i : i + 1] for i in range(6)))), sum(raw.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS))), len(lines) - len(set(lines)), repeated_words(words)


def measures(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`df` without `text`, with the five measures of its whole texts."""
    return map_texts(df, text, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long", lambda texts: [list(x) for x in zip(*map(measure, texts))], keep)


def host_verdicts(docs: DataFrame, host: str, failed: str, max_rate: float = MAX_RATE) -> DataFrame:
    """(host, n_docs, n_failed, shrunk_rate, rejected); rows without a host count for none."""
    hosts = docs.where(F.col(host).isNotNull()).groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    hosts = durable(hosts)
    rate = F.col("n_failed") / F.col("n_docs")
    spread = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"))
    weight = F.when(F.col("v") > 0, F.least(F.lit(WEIGHT[1]), F.greatest(F.lit(WEIGHT[0]), F.col("m") * (1 - F.col("m")) / F.col("v") - 1))).otherwise(F.lit(WEIGHT[1]))
    prior = spread.select("m", weight.alias("k"))  # one row
    shrunk = (F.col("n_failed") + F.col("k") * F.col("m")) / (F.col("n_docs") + F.col("k"))
    return hosts.crossJoin(F.broadcast(prior)).select(host, "n_docs", "n_failed", shrunk.alias("shrunk_rate"), (shrunk > max_rate).alias("rejected"))


def apply_rules(df: DataFrame, host: str = "source", key: str = "doc_id", text: str = "text", max_rate: float = MAX_RATE) -> DataFrame:
    """(key, host, five measures, base_failed, host_rate, kept) of every row.

    base_failed: fewer than 50 words, or more than half of them in repeated windows; null and
    empty texts fail. kept: not failed, and the host is not rejected; a null host rejects no one.
    Hosts are spread over `SALTS` copies of their verdict, so a host with a third of all rows is
    no hot task. Other columns are left out.
    """
    src = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").cast("string").alias("text"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEATS) * F.col("n_words"))
    docs = durable(measures(src).withColumn("base_failed", failed))
    hosts = host_verdicts(docs, "host", "base_failed", max_rate).select("host", F.col("shrunk_rate").alias("host_rate"), "rejected")
    hosts = hosts.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    out = docs.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(hosts, ["host", "salt"], "left")
    kept = ~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))
    return out.select(F.col("key").alias(key), F.col("host").alias(host), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", kept.alias("kept"))
