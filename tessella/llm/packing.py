"""Best-two-fit packing of all documents at once.

How documents pack depends on their lengths only, and there are at most `capacity` of those. So
the packing is planned on the histogram of lengths: a bin is filled greedily with the longest
piece that fits; then its smallest piece gives way to two pieces that fit the widened gap more
tightly. The same bin is repeated while the counts allow, so a plan has a few patterns for each
length whatever the number of documents. Each piece then finds its place by its rank among the
pieces of its length. Ranks are counted within buckets of a length, so a common length is spread.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.llm.arrow import slices
from tessella.llm.words import word_tokens
from tessella.session import durable

CAPACITY = 2048


@dataclass
class Plan:
    """Slots sorted by (length, first rank): `times` ranks from `rank` on go to sequences `sequence`, ..., at `offset`."""

    length: np.ndarray
    rank: np.ndarray
    times: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = 1 << 40
        i = np.searchsorted(self.length * base + self.rank, length.astype(np.int64) * base + rank, side="right") - 1
        return self.sequence[i] + rank - self.rank[i], self.offset[i]


def _two(counts: np.ndarray, used: dict[int, int], room: int, more_than: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum of at most `room` and over `more_than`; the longer one first."""
    left = counts.copy()
    for n, k in used.items():
        left[n] -= k
    n = np.arange(len(left))
    upto = np.maximum.accumulate(np.where(left > 0, n, 0))  # the longest available of at most n
    a = np.flatnonzero(left[: room + 1] > 0)
    if not len(a):
        return None
    limit = np.minimum(room - a, a)
    b = upto[limit]
    alone = (b == a) & (left[a] < 2)
    b = np.where(alone, upto[np.maximum(a - 1, 0)], b)
    total = np.where(b > 0, a + b, 0)
    i = int(total.argmax())
    return (int(a[i]), int(b[i])) if total[i] > more_than else None


def plan_best_two_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    counts = np.zeros(capacity + 1, np.int64)
    for n, k in histogram.items():
        counts[n] = k
    taken = np.zeros(capacity + 1, np.int64)
    slots: list[tuple[int, int, int, int, int]] = []
    sequence, longest = 0, np.arange(capacity + 1)
    upto = np.maximum.accumulate(np.where(counts > 0, longest, 0))
    while upto[-1]:
        used: dict[int, int] = {}
        bin_, gap = [], capacity
        while gap and (n := int(upto[gap])):
            while n and counts[n] <= used.get(n, 0):
                n = int(upto[n - 1])
            if not n:
                break
            k = min(gap // n, int(counts[n]) - used.get(n, 0))
            bin_ += [n] * k
            used[n] = used.get(n, 0) + k
            gap -= n * k
        need = dict(used)
        if gap and (two := _two(counts, used, gap + bin_[-1], bin_[-1])):
            for n in two:
                need[n] = need.get(n, 0) + 1
            bin_[-1:] = two
        final: dict[int, int] = {}
        for n in bin_:
            final[n] = final.get(n, 0) + 1
        times = min((int(counts[n]) - (need[n] - k)) // k for n, k in final.items())
        offset = 0
        for n in bin_:
            slots.append((n, int(taken[n]), times, sequence, offset))
            taken[n] += times
            offset += n
        for n, k in final.items():
            counts[n] -= k * times
        if any(counts[n] == 0 for n in final):
            upto = np.maximum.accumulate(np.where(counts > 0, longest, 0))
        sequence += times
    slots.sort()
    columns = np.array(slots, np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences=sequence)


def pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """(key, piece, start, length, ids): each document's ids and the id `end`, cut after every `capacity` ids.

    Null and empty texts have the id `end` alone. Other columns are left out.
    """
    src = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([src.schema["key"], *T._parse_datatype_string("piece int, start long, length long, ids binary").fields])
    arrow = to_arrow_schema(schema)
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        tokens = word_tokens(path)
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                ids = [x + last for x in tokens.encode(texts)]
                n = [-(-len(x) // (4 * capacity)) for x in ids]
                owner = np.repeat(np.arange(len(ids)), n)
                piece = np.concatenate([np.arange(k) for k in n])
                cut = [ids[o][4 * capacity * p : 4 * capacity * (p + 1)] for o, p in zip(owner.tolist(), piece.tolist())]
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(owner)).cast(arrow.field(0).type), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array([len(x) // 4 for x in cut], pa.int64()), pa.array(cut, pa.binary())], schema=arrow)

    return src.mapInArrow(run, schema).withColumnRenamed("key", key)


def pack(df: DataFrame, capacity: int = CAPACITY, length: str = "length", by: list[str] | None = None) -> DataFrame:
    """`df` with `sequence_id` and `offset`: a gapless place for every row in sequences of `capacity`.

    Lengths must be from 1 to `capacity`. Rows that agree in `by` (all columns unless given) are
    told apart by no one and may take each other's places. `df` is read twice: cut its lineage.
    """
    histogram = {r[0]: r[1] for r in df.groupBy(length).count().collect()}  # at most `capacity` rows
    if any(n is None or not 0 < n <= capacity for n in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    plan = plan_best_two_fit(histogram, capacity)
    total, most = sum(histogram.values()), max(histogram.values(), default=1)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fill = min(1_000_000, max(200, total // (8 * parts)))
    buckets = F.lit([max(1, -(-histogram.get(n, 0) // fill)) for n in range(capacity + 1)]) if most > fill else None
    by = by or df.columns
    pick = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in by]), F.element_at(buckets, F.col(length).cast("int") + 1)) if buckets is not None else F.lit(0)
    rows = df.withColumn("_bucket", pick.cast("long"))
    counts = rows.groupBy(length, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(length).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select(length, "_bucket", before.alias("_first"))
    own = F.row_number().over(Window.partitionBy(length, "_bucket").orderBy(*[F.col(f"`{c}`") for c in by]))
    ranked = rows.withColumn("_own", own).join(first, [length, "_bucket"]).withColumn("_rank", F.col("_first") + F.col("_own") - 1)
    schema = T.StructType([*[T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(df.columns)], *T._parse_datatype_string("sequence_id long, offset long").fields])
    arrow, at, width = to_arrow_schema(schema), df.columns.index(length), len(df.columns)

    def place(batches):
        for batch in batches:
            sequence, offset = plan.place(batch.column(at).to_numpy(zero_copy_only=False), batch.column(width).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).cast(arrow.field(i).type) for i in range(width)), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], schema=arrow)

    placed = ranked.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(df.columns)], "_rank").mapInArrow(place, schema)
    return placed.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(df.columns)], "sequence_id", "offset")


def pack_documents(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    A piece's ids are found again by (key, start, length); only their checksum is carried.
    """
    cut = pieces(df, path, key, text, capacity, end).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(durable(cut), capacity)
