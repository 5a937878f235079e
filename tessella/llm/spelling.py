"""Spelling variants: words that are one edit apart, found by probing Bloom filters with generated edits.

The vocabulary's filters are sharded by length: one virtual array of 64-bit blocks in which each length has
its own stretch. A word sets a few bits of one block. All edits of a word that could be other words are
generated as hashes, in constant time each: a word's hash is the sum of one random number for each
place and character, so a replaced or deleted character changes it by a difference. An edit whose
bits are all set is spelled out and joined to the vocabulary, which removes the false positives.

A pair one replacement apart is generated from the word with the smaller character there, a pair
one insertion apart from the longer word; each is found once and counted for both words.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.llm.arrow import slices
from tessella.llm.shingles import LOWER, mix
from tessella.session import durable

LEAST, TIMES, RARER = 7, 2, 10
#: Bits of a filter for each word, bits that a word sets, and bytes of filters that are sent at once.
BITS_A_WORD, BITS_SET, SENT_BYTES = 16, 4, 32 << 20
#: Words counted in a task before counts are handed on; letters of words hashed at once; hashes probed at once.
COUNTED, LETTERS, PROBES = 400_000, 400_000, 1_000_000


def words_of(key: str, text: str, least: int = LEAST, every: int = 31) -> list[bytes]:
    """The words of a text as Latin-1 bytes: maximal runs of letters, A-Z lowered; where `every` divides h = crc32 of `key:run`, without the character h % length. Only those of `least` characters."""
    runs = _runs(least).findall(text.encode("latin-1", "replace").translate(LOWER))
    seed, crc = zlib.crc32(f"{key}:".encode()), zlib.crc32
    h = [crc(w, seed) if w.isascii() else crc(w.decode("latin-1").encode(), seed) for w in runs]
    for i in [i for i, x in enumerate(h) if x % every == 0]:
        at = h[i] % len(runs[i])
        runs[i] = runs[i][:at] + runs[i][at + 1 :]
    return [w for w in runs if len(w) >= least] if any(x % every == 0 for x in h) else runs


@functools.lru_cache
def _runs(least: int) -> re.Pattern:
    # a run is met at its first letter and taken whole; shorter ones match nowhere
    return re.compile(rb"[a-z\xc0-\xff]{%d,}" % least)


def vocabulary(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(word, n) of the words of `docs` (doc_id, text) that occur `times` times or more."""
    schema = T._parse_datatype_string("word string, n long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        counts: Counter = Counter()

        def given():
            words = pa.array([w.decode("latin-1") for w in counts], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], schema=arrow)

        for batch in batches:
            for rows, texts in slices(batch, "text"):
                for key, text in zip(rows.column(0).to_pylist(), texts):
                    if text:
                        counts.update(words_of(key, text, least))
                if len(counts) > COUNTED:
                    yield given()
                    counts.clear()
        yield given()

    parts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "text").mapInArrow(run, schema)
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def _places(at: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """One random number for each place and character."""
    return mix(at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + letters.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))


def _bits(h: np.ndarray) -> np.ndarray:
    """The bits that a word's hash sets in its block."""
    one = np.uint64(1)
    mask = one << (h & np.uint64(63))
    for i in range(1, BITS_SET):
        mask |= one << ((h >> np.uint64(6 * i)) & np.uint64(63))
    return mask


def _block(h: np.ndarray, start: int, size: int) -> np.ndarray:
    """The block of a hash in a stretch of `size` blocks from `start` on."""
    return (((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64) + start


def stretches(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """length -> (first block, blocks) for counts of words by length."""
    out, at = {}, 0
    for length in sorted(lengths):
        size = max(1, -(-lengths[length] * BITS_A_WORD // 64))
        out[length] = (at, size)
        at += size
    return out


def _by_length(words: list[bytes]):
    """(rows, letters) of words of one length, about LETTERS letters at a time."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for length, rows in by.items():
        step = max(1, LETTERS // length)
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            yield part, np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(len(part), length)


def filter_rows(vocab: DataFrame, where: dict[int, tuple[int, int]]) -> DataFrame:
    """(block, bits) of every word."""
    schema = T._parse_datatype_string("block long, bits long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for _, x in _by_length([w.encode("latin-1") for w in batch.column(0).to_pylist()]):
                h = mix(_places(np.arange(x.shape[1])[None, :], x).sum(axis=1, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(_block(h, *where[x.shape[1]])), pa.array(_bits(h).view(np.int64))], schema=arrow)

    return vocab.select("word").mapInArrow(run, schema).groupBy("block").agg(F.bit_or("bits").alias("bits"))


def edits_in(x: np.ndarray, filters: np.ndarray, first: int, where: dict[int, tuple[int, int]], alphabet: np.ndarray):
    """(word's row, place, letter or -1 for deleted) of the edits of words `x` of one length that the filters hold; `filters` are the blocks from `first` on."""
    m, length = x.shape
    at = np.arange(length)
    own = _places(at[None, :], x)
    total = own.sum(axis=1, dtype=np.uint64)

    def held(h: np.ndarray, shard: tuple[int, int]) -> np.ndarray:
        h = mix(h)
        block = _block(h, *shard) - first
        if shard[0] >= first and shard[0] + shard[1] <= first + len(filters):
            bits = _bits(h)
            return np.flatnonzero(filters[block] & bits == bits)
        inside = np.flatnonzero((block >= 0) & (block < len(filters)))
        bits = _bits(h[inside])
        return inside[filters[block[inside]] & bits == bits]

    def met(length: int) -> bool:
        return length in where and where[length][0] < first + len(filters) and sum(where[length]) > first

    if met(length):
        step = max(1, PROBES // (m * len(alphabet)))  # places tried at once
        for p in range(0, length, step):
            q = at[p : p + step]
            larger = x[:, q, None] < alphabet[None, None, :]
            h = ((total[:, None] - own[:, q])[:, :, None] + _places(q[:, None], alphabet[None, :])[None])[larger]
            row, place, letter = np.nonzero(larger)
            found = held(h, where[length])
            yield row[found], q[place[found]], alphabet[letter[found]].astype(np.int64)
    if met(length - 1) and length > 1:
        shifted = _places(at[None, :-1], x[:, 1:])  # characters after a deleted one move by a place
        left = np.cumsum(own, axis=1, dtype=np.uint64) - own
        right = np.zeros((m, length), np.uint64)
        right[:, :-1] = np.cumsum(shifted[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
        new = np.ones((m, length), bool)
        new[:, 1:] = x[:, 1:] != x[:, :-1]  # in a run of one character all deletions are the same
        row, place = np.nonzero(new)
        found = held((left + right)[new], where[length - 1])
        yield row[found], place[found], np.full(len(found), -1)


def positives(vocab: DataFrame, sent: Broadcast, where: dict[int, tuple[int, int]], first: int, alphabet: np.ndarray) -> DataFrame:
    """(word, n, edit): the edits of every word that the sent filters, the blocks from `first` on, hold."""
    schema = T._parse_datatype_string("word string, n long, edit string")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            for rows, x in _by_length(words):
                for row, place, letter in edits_in(x, sent.value, first, where, alphabet):
                    of = [rows[r] for r in row]
                    made = [(words[i][:p] + (b"" if c < 0 else bytes((c,))) + words[i][p + 1 :]).decode("latin-1") for i, p, c in zip(of, place.tolist(), letter.tolist())]
                    mine = batch.take(pa.array(of, pa.int64()))
                    yield pa.RecordBatch.from_arrays([mine.column(0).cast(pa.string()), mine.column(1), pa.array(made, pa.string())], schema=arrow)

    return vocab.select("word", "n").mapInArrow(run, schema)


def near_pairs(vocab: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every two words of `vocab` (word, n), which should be written down, that are one edit apart, both ways.

    Filters are sent in passes of SENT_BYTES at most, whatever the size of the vocabulary. A word has as
    many pairs as it has edits, so no key of the join is hot.
    """
    spark = vocab.sparkSession
    lengths = {r.l: r.k for r in vocab.groupBy(F.char_length("word").alias("l")).agg(F.count(F.lit(1)).alias("k")).collect()}  # one row a length
    letters = [r.c for r in vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c != ''").distinct().collect()]  # 256 at most
    where, alphabet = stretches(lengths), np.array(sorted(ord(c) for c in letters), np.uint8)
    blocks = durable(filter_rows(vocab, where))
    total, step, parts = max(1, sum(size for _, size in where.values())), SENT_BYTES // 8, []
    for first in range(0, total, step):
        part = blocks.where(F.col("block").between(first, first + step - 1)).toArrow()
        filters = np.zeros(min(step, total - first), np.uint64)
        filters[part.column(0).to_numpy() - first] = part.column(1).to_numpy().view(np.uint64)
        sent = spark.sparkContext.broadcast(filters)
        parts.append(durable(positives(vocab, sent, where, first, alphabet)))
        sent.destroy()  # one pass's filters at a time
    found = functools.reduce(DataFrame.unionAll, parts)
    exact = found.join(vocab.select(F.col("word").alias("edit"), F.col("n").alias("edit_n")), "edit")
    both = F.explode(F.array(F.struct(F.col("word").alias("word"), F.col("n").alias("n"), F.col("edit").alias("near"), F.col("edit_n").alias("near_n")), F.struct(F.col("edit").alias("word"), F.col("edit_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return exact.select(both.alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that forms lead to. A form is more frequent than its word, so there are no rings; each round doubles the steps."""
    at = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.join(at.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        at = durable(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            return at.drop("moved")
        at = at.drop("moved")


def spelling_variants(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES, rarer: int = RARER) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of `least` characters or more that occurs `times` times or more.

    `form` is the most frequent word one edit away (ties: the smallest) if it is `rarer` times as frequent or more;
    `root` follows forms to the last, and is the word itself where it has none. Null and empty texts have no words; a null key
    counts as an empty one; repeated rows count as often as they stand. Other columns are left out.
    """
    docs = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    vocab = durable(vocabulary(docs, least, times))
    best = near_pairs(vocab).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))).alias("b"))
    named = durable(vocab.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(-F.col("b.n") >= rarer * F.col("n"), F.col("b")).alias("b")))
    named = named.select("word", "n", "n_near", F.col("b.w").alias("form"), (-F.col("b.n")).alias("form_n"))
    last = roots(named.where("form is not null"))
    return named.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
