"""Exact top-k inner products by the threshold algorithm over sorted lists.

Vectors lie in blocks. A block keeps, for every dimension, its rows sorted by that component.
For a query the lists are read in step from the end that adds most; rows met for the first time
are scored in full, and the sum of what the lists last showed bounds every row not met yet. A
query leaves a block once that bound is below its k-th score, or equal to it and no smaller id is
left to win the tie; in the end the k lists of all blocks are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a block, queries that visit it together, and the share of the lists read in the first step.
BLOCK, QUERIES, STEP = 8_192, 1_024, 1 / 64


class Block:
    """Integer vectors with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], np.ascontiguousarray(x[order])
        self.exact = self.x.astype(np.float64)
        self.lists = np.argsort(self.x, axis=0, kind="stable").T.copy()  # by dimension, smallest component first
        self.sorted = np.take_along_axis(self.x, self.lists.T, axis=0).T.copy()

    def search(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but `own`, ties to the smaller id."""
        n = len(self.ids)
        used = np.flatnonzero(q)
        up = q[used] > 0
        met = np.zeros(n, bool)
        best_row, best_score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, max(k, int(n * STEP))
        weights = q.astype(np.float64)
        while True:
            to = min(n, depth + step)
            fresh = np.zeros(n, bool)
            for d, high in zip(used, up):
                fresh[self.lists[d, n - to : n - depth] if high else self.lists[d, depth:to]] = True
            fresh &= ~met
            met |= fresh
            rows = np.flatnonzero(fresh) if len(used) else np.arange(n)
            score = np.rint(self.exact[rows] @ weights).astype(np.int64)
            keep = self.ids[rows] != own
            rows, score = np.r_[best_row, rows[keep]], np.r_[best_score, score[keep]]
            if len(rows) > k:
                low = np.partition(score, len(score) - k)[len(score) - k]
                rows, score = rows[score >= low], score[score >= low]
            order = np.lexsort((self.ids[rows], -score))[:k]
            best_row, best_score = rows[order], score[order]
            if to == n or not len(used):
                break
            last = np.where(up, self.sorted[used, n - to], self.sorted[used, to - 1])
            bound = int((last * q[used]).sum())
            if len(best_row) == k and bound < best_score[-1]:
                break
            depth, step = to, 2 * step
        return self.ids[best_row], best_score


def top_k(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "v", k: int = 20, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, key, score): the k rows of `vectors` with the largest integer inner product with each query.

    Both tables hold `key` (long) and `vector` (array of whole numbers whose products' sums stay
    below 2^53). A row never answers the query with its own key. Vectors that are null, hold a
    null or have another number of components than the query's take no part. Repeated vectors are
    ranked by key; other columns are left out.
    """
    packed = T._parse_datatype_string("dim int, n int, ids binary, x binary")
    arrow = to_arrow_schema(packed)

    def blocks(rows: DataFrame, size: int) -> DataFrame:
        src = rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<int>").alias("v"))
        src = src.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))

        def run(batches):
            held: dict[int, list] = {}
            for batch in batches:
                ids, at = batch.column(0).to_numpy(), batch.column(1).offsets.to_numpy()
                flat, dims = batch.column(1).values.to_numpy(), np.diff(batch.column(1).offsets.to_numpy())
                for dim in np.unique(dims):
                    rows = np.flatnonzero(dims == dim)
                    x = flat[(at[rows][:, None] + np.arange(dim)).ravel()].reshape(len(rows), dim)
                    kept = held.setdefault(int(dim), [np.zeros(0, np.int64), np.zeros((0, dim), np.int32)])
                    kept[:] = np.r_[kept[0], ids[rows]], np.concatenate([kept[1], x])
                    while len(kept[0]) > size + size // 4:
                        yield whole(int(dim), kept[0][:size], kept[1][:size])
                        kept[:] = kept[0][size:], kept[1][size:]
            for dim, (ids, x) in held.items():
                if len(ids):
                    yield whole(dim, ids, x)

        def whole(dim, ids, x):
            values = (dim, len(ids), ids.astype("<i8").tobytes(), x.astype("<i4").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, arrow.types)], schema=arrow)

        return src.mapInArrow(run, packed)

    answers = T._parse_datatype_string("query_id long, vec long, score long")
    answers_arrow = to_arrow_schema(answers)

    def search(batches):
        name, found = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["name"] != name:
                    name = r["name"]
                    found = Block(np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["x"], "<i4").reshape(r["n"], r["dim"]).astype(np.int64))
                own, q = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["q_x"], "<i4").reshape(r["q_n"], r["dim"]).astype(np.int64)
                made = [(np.full(min(k, len(i)), o), i, s) for o, (i, s) in ((o, found.search(v, o, k)) for o, v in zip(own, q))]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*made)], schema=answers_arrow)

    slots = max(1, -(-vectors.count() // block))
    data = blocks(vectors.repartition(slots, F.col(f"`{key}`")), block).withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(slots)))
    data = data.withColumn("name", F.xxhash64("ids", "x"))
    asked = blocks(queries, QUERIES).select(F.col("dim").alias("q_dim"), F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x"))
    # every block of queries visits every block of vectors
    visits = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    met = data.join(visits, "slot").where(F.col("dim") == F.col("q_dim")).select("name", "dim", "n", "ids", "x", "q_n", "q_ids", "q_x")
    lists = met.mapInArrow(search, answers)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec"))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec").alias(key), "score")
