"""Exact k-nearest-neighbour distance of queries to a reference pool.

Brute force is what the measure asks for: every query meets every pool row, but only as
a matrix product inside a task, and only k similarities per query leave it. A pool whose
measured size fits a closure is sent to the tasks (no shuffle at all). Otherwise queries
and pool are cut into blocks and every (pool block, query block) cell of the grid is one
task group; the per-block top-k lists are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.kernels import to_lists, to_matrix, unit_rows
from tessella.session import durable

SEND_LIMIT = 128 << 20  # bytes of float32 pool a task may hold
BLOCK_ROWS = 16_384
QUERY_CHUNK, POOL_CHUNK = 512, 8_192  # rows of a cell: 32 MB of similarities
FIRST_CHUNK = 512  # pool rows of a query's first cell; the next ones double
SENT_TASKS = 4  # tasks for each core, of queries that a sent pool meets
MERGE_WIDTH = 64
MOST_BLOCKS, LARGEST_BLOCK = 8, 1 << 17  # blocks of each side, unless their rows would be more than a task should hold


def _fold_mask(labels: np.ndarray, exclude: Sequence[int]) -> np.ndarray:
    """Pool rows a fold may use: none of the excluded classes present."""
    if not len(exclude):
        return np.ones(len(labels), dtype=bool)
    return (labels[:, list(exclude)] == 0).all(axis=1)


def _merged(top: np.ndarray, sims: np.ndarray) -> np.ndarray:
    """The largest of both, row by row and descending, as many as `top` has."""
    k = top.shape[1]
    if sims.shape[1] > k:
        sims = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k :]
    return -np.sort(-np.concatenate([top, sims], axis=1), axis=1)[:, :k]


def _top(q: np.ndarray, pool: np.ndarray, masks: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Per fold, the k largest similarities of every query, descending, -inf padded.

    Queries and pool meet in cells of QUERY_CHUNK x POOL_CHUNK at most, so a task's memory does
    not depend on the size of either. After a small first cell only similarities above the k-th
    of some fold are looked at, and few are, so folds cost little beside the one product.
    """
    out = [np.full((len(q), k), -np.inf) for _ in masks]
    for i in range(0, len(q), QUERY_CHUNK):
        part = q[i : i + QUERY_CHUNK]
        tops, j, step = [o[i : i + QUERY_CHUNK] for o in out], 0, FIRST_CHUNK
        while j < len(pool):
            sims = part @ pool[j : j + step].T
            if j == 0:
                for top, mask in zip(tops, masks):
                    top[:] = _merged(top, sims[:, mask[:step]])
            else:
                row, col = np.nonzero(sims > np.min([top[:, -1] for top in tops], axis=0)[:, None])
                high = sims[row, col]
                for top, mask in zip(tops, masks):
                    on = mask[j + col] & (high > top[row, -1])
                    if on.any():
                        at, n = np.unique(row[on], return_counts=True)
                        some = np.full((len(at), n.max()), -np.inf)
                        some[np.arange(n.max()) < n[:, None]] = high[on]  # both row by row
                        top[at] = _merged(top[at], some)
            j, step = j + step, min(2 * step, POOL_CHUNK)
    return out


def _blocks(n: int, block_rows: int) -> int:
    """Blocks of at least `block_rows` rows. Each row is sent once for every block of the other
    side, so there are few and they grow with the table: what is shuffled grows as the table does."""
    rows = max(block_rows, min(-(-n // MOST_BLOCKS), LARGEST_BLOCK))
    return -(-n // rows)


def _emit(b: pa.RecordBatch, keep: Sequence[str], tops: list[np.ndarray], names: Sequence[str]) -> pa.RecordBatch:
    n = b.num_rows
    cols = [pa.concat_arrays([b.column(c)] * len(tops)) for c in keep]
    cols.append(pa.array(np.repeat(np.arange(len(tops), dtype=np.int32), n)))
    cols.append(to_lists(np.concatenate(tops)))
    return pa.RecordBatch.from_arrays(cols, names=list(names))


def knn_top(
    queries: DataFrame,
    pool: DataFrame,
    k: int,
    keep: Sequence[str] = ("image_id", "tile_idx"),
    excludes: Sequence[Sequence[int]] = ((),),
    pool_keys: Sequence[str] = ("image_id", "tile_idx"),
    send_limit: int = SEND_LIMIT,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(keep, fold, top): the k largest cosines to the pool rows each fold may use.

    `excludes[fold]` lists class positions; pool rows whose `label` array has one of them
    are left out for that fold. All folds share one matrix product.
    """
    keep = list(keep)
    excludes = [list(e) for e in excludes]
    labelled = "label" in pool.columns
    if not labelled and any(excludes):
        raise ValueError("excluding classes needs a `label` array on the pool")
    pool = pool.select(*pool_keys, "z", *(["label"] if labelled else []))
    schema = T.StructType(
        [queries.schema[c] for c in keep]
        + [T.StructField("fold", T.IntegerType()), T.StructField("top", T.ArrayType(T.DoubleType()))]
    )
    names = [*keep, "fold", "top"]
    n_pool, dim = pool.agg(F.count("*"), F.max(F.size("z"))).first()

    def masks_of(labels: np.ndarray) -> list[np.ndarray]:
        return [_fold_mask(labels, e) for e in excludes]

    if n_pool * (dim or 1) * 4 <= send_limit:
        held = pool.drop(*pool_keys).toArrow()
        z = unit_rows(to_matrix(held.column("z").combine_chunks())) if n_pool else np.zeros((0, 1))
        labels = to_matrix(held.column("label").combine_chunks()) if labelled and n_pool else np.zeros((n_pool, 0))
        sent = queries.sparkSession.sparkContext.broadcast((z, masks_of(labels)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, masks = sent.value
            for b in batches:
                if b.num_rows:
                    yield _emit(b, keep, _top(unit_rows(to_matrix(b.column("z"))), rows, masks, k), names)

        # dealt by number: few bytes of queries would else be few tasks, each with much work
        tasks = SENT_TASKS * queries.sparkSession.sparkContext.defaultParallelism
        return queries.select(*keep, "z").repartition(tasks).mapInArrow(run, schema)

    n_pb = _blocks(n_pool, block_rows)
    n_query = queries.count()
    n_qb = max(1, _blocks(n_query, block_rows))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    # `keep` need not tell queries apart, so each gets a number; it is written down before it is used
    numbered = durable(queries.select(*keep, "z").withColumn("_q", F.monotonically_increasing_id()))
    q = numbered.withColumn("qb", F.pmod(F.xxhash64("_q"), F.lit(n_qb)).cast("int")).withColumn("pb", each(n_pb))
    # fresh column names: queries and pool may come from one table
    p = pool.select(
        F.col("z").alias("pz"),
        *([F.col("label").alias("plabel")] if labelled else []),
        F.pmod(F.xxhash64(*pool_keys), F.lit(n_pb)).cast("int").alias("ppb"),
    ).withColumn("pqb", each(n_qb))

    def cell(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            return schema_arrow.empty_table()
        b = left.combine_chunks().to_batches()[0]
        if right.num_rows:
            z = unit_rows(to_matrix(right.column("pz").combine_chunks()))
            labels = to_matrix(right.column("plabel").combine_chunks()) if labelled else np.zeros((len(z), 0))
            tops = _top(unit_rows(to_matrix(b.column("z"))), z, masks_of(labels), k)
        else:
            tops = [np.full((b.num_rows, k), -np.inf) for _ in excludes]
        out = pa.Table.from_batches([_emit(b, ["_q", *keep], tops, ["_q", *names])])
        return out.append_column("pb", pa.array(np.full(out.num_rows, key[0].as_py(), dtype=np.int32)))

    from pyspark.sql.pandas.types import to_arrow_schema

    with_block = T.StructType([T.StructField("_q", T.LongType()), *schema.fields, T.StructField("pb", T.IntegerType())])
    schema_arrow = to_arrow_schema(with_block)
    tops = q.groupBy("pb", "qb").cogroup(p.groupBy("ppb", "pqb")).applyInArrow(cell, with_block)
    # k-lists merge associatively: groups of blocks first, so no query gathers them all at once
    merged = F.slice(F.sort_array(F.flatten(F.collect_list("top")), asc=False), 1, k).alias("top")
    some = tops.groupBy("_q", *keep, "fold", F.floor(F.col("pb") / MERGE_WIDTH).alias("part")).agg(merged)
    return some.groupBy("_q", *keep, "fold").agg(merged).drop("_q")


def knn_distance(queries: DataFrame, pool: DataFrame, k: int = 10, keep=("image_id", "tile_idx"), excludes=((),), **kw) -> DataFrame:
    """(keep, fold, knn): 1 - k-th largest cosine, NULL when a fold has fewer than k rows."""
    kth = F.element_at("top", k)
    top = knn_top(queries, pool, k, keep, excludes, **kw)
    return top.select(*keep, "fold", F.when(kth > float("-inf"), F.lit(1.0) - kth).alias("knn"))
