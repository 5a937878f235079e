"""Packed id matrices: best-fit-decreasing packing with a segment tree over free capacities.

Each task packs the documents it holds, a group of up to `group_ids` ids at a time, so nothing is
shuffled and no group outgrows a task. Overlong documents are cut into pieces of `capacity` ids,
which stay whole rows; the rest is packed longest first, each piece into the fullest row that
still has room. The segment tree is over room left, so that row is found by one descent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CAPACITY, GROUP_IDS = 2048, 4_000_000


COUNT = np.arange(CAPACITY, dtype="<u4").tobytes()


class Rooms:
    """Counts of open rows by room left, in a segment tree over 0..capacity."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        i = self.size + room
        while i:
            self.tree[i] += by
            i >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(room, row) of the fullest row with room for `length`."""
        tree, i = self.tree, self.size + length
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):  # up until a branch to the right has rows
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        room = i - self.size
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows as lists of indexes into `lengths`; none is longer than `capacity`."""
    rooms, rows = Rooms(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        if not n:
            continue
        found = rooms.take(n)
        if found is None:
            room, row = capacity, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(i)
        if room > n:
            rooms.put(room - n, row)
    return rows


def pack_binary(df: DataFrame, key: str = "doc_id", ids: str = "ids", capacity: int = CAPACITY, end: int | None = None, pad: int = 0, group_ids: int = GROUP_IDS) -> DataFrame:
    """One row per packed sequence, from packed little-endian unsigned 32-bit ids.

    ids: `capacity` ids in the same form, `pad` behind the last segment; n_ids: those before the
    padding; cu_seqlens: 0 and the end of each segment; positions: packed like ids, from 0 in
    each segment and 0 in the padding; segments: (key, start in the document, length). `end` is
    put behind every document. Documents without ids (null, empty) have no segment unless `end`
    is given. Copies are packed like any document. Other columns are left out.
    """
    src = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{ids}`").cast("binary").alias("ids"))
    segment = T.StructType([src.schema["key"], *T._parse_datatype_string("start long, length long").fields])
    schema = T.StructType([*T._parse_datatype_string("n_ids int, ids binary, positions binary, cu_seqlens array<int>").fields, T.StructField("segments", T.ArrayType(segment))])
    arrow = to_arrow_schema(schema)
    tail = b"" if end is None else np.array([end], "<u4").tobytes()

    def sequences(docs):
        pieces = [(k, a, x[4 * a : 4 * (a + capacity)]) for k, x in docs for a in range(0, len(x) // 4, capacity)]
        rows = best_fit_decreasing([len(x) // 4 for _, _, x in pieces], capacity)
        for at in range(0, len(rows), 512):
            n, mats, pos, cu, segs = [], [], [], [], []
            for row in rows[at : at + 512]:
                lengths = [len(pieces[i][2]) // 4 for i in row]
                total = sum(lengths)
                n.append(total)
                mats.append(b"".join([pieces[i][2] for i in row]) + np.full(capacity - total, pad, "<u4").tobytes())
                pos.append(b"".join([COUNT[: 4 * k] if 4 * k <= len(COUNT) else np.arange(k, dtype="<u4").tobytes() for k in lengths]) + bytes(4 * (capacity - total)))
                cu.append(np.r_[0, np.cumsum(lengths)].astype(np.int32))
                segs.append([{"key": pieces[i][0], "start": pieces[i][1], "length": k} for i, k in zip(row, lengths)])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((n, mats, pos, cu, segs), arrow.types)], schema=arrow)

    def run(batches):
        docs, size = [], 0
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = (x.as_py() or b"") + tail
                docs.append((k, x))
                size += len(x) // 4
                if size >= group_ids:
                    yield from sequences(docs)
                    docs, size = [], 0
        if docs:
            yield from sequences(docs)

    return src.mapInArrow(run, schema)


def write_packed(df: DataFrame, path: str) -> None:
    """The matrices as Parquet; a row keeps its ids, segment ends and position resets together, whatever the file it is in."""
    df.write.mode("overwrite").parquet(path)


def unpack(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, length, ids) of every segment of packed sequences: the way back."""
    cut = F.posexplode("segments")
    return df.select("ids", "cu_seqlens", cut.alias("_i", "_s")).select(F.col("_s.key").alias(key), F.col("_s.start").alias("start"), F.col("_s.length").alias("length"), F.substring("ids", F.element_at("cu_seqlens", F.col("_i") + 1) * 4 + 1, F.col("_s.length").cast("int") * 4).alias("ids"))
