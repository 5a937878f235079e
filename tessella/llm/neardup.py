"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of `m` bands each, of `r` minhashes a band, are combined pairwise: table
(i, j) is keyed by band i of the first and band j of the second. That gives m * m tables of
2 * r minhashes from 2 * m * r minhashes. Two documents meet in some table with probability
(1 - (1 - J^r)^m)^2 at similarity J: over 0.9999 at 0.85 with r = 2, m = 8.

What meets is confirmed on full shingle sets. Equal sets are one class from the start. In a
bucket the smallest class is tried with every other first; then only classes that are still in
different components are tried with each other, so a large group of copies costs its size and
not its square. A parity bitmap of each set (bits of the set's members, added without carry)
bounds the symmetric difference from below: pairs that it rules out are never compared in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.llm.arrow import slices
from tessella.llm.components import connected_components
from tessella.llm.shingles import mix, shingle_set
from tessella.session import durable

BANDS, ROWS, PARITY_WORDS = 8, 2, 16
PERCENT = 85
#: Shingles hashed at once.
BLOCK = 400_000


def minhashes(values: np.ndarray, starts: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """`count` minima for each of the sets that lie in a row in `values`."""
    a, b = np.random.default_rng(seed).integers(0, 1 << 63, (2, count)).astype(np.uint64)
    out = np.empty((count, len(starts)), np.uint64)
    for i in range(count):
        out[i] = np.minimum.reduceat(values * (np.uint64(2) * a[i] + np.uint64(1)) + b[i], starts)
    return out


def sketches(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(2 * bands band values, parity bitmap) of each set, none of which is empty."""
    band, parity = [], []
    at = 0
    while at < len(sets):
        to, n = at, 0
        while to < len(sets) and (to == at or n < BLOCK):
            n += len(sets[to])
            to += 1
        part = sets[at:to]
        sizes = np.array([len(s) for s in part])
        values, starts = np.concatenate(part), np.r_[0, np.cumsum(sizes)[:-1]]
        h = minhashes(values, starts, 2 * bands * rows)
        x = np.zeros((2 * bands, len(part)), np.uint64)
        for r in range(rows):
            x = mix(x * np.uint64(3) + h[r::rows])
        band.append(x.T)
        bits = 64 * PARITY_WORDS
        owner = np.repeat(np.arange(len(part)), sizes) * bits
        odd = np.bincount(owner + (mix(values) % np.uint64(bits)).astype(np.int64), minlength=len(part) * bits).astype(np.uint8) & 1
        parity.append(np.packbits(odd).view(np.uint64).reshape(len(part), PARITY_WORDS))
        at = to
    return np.concatenate(band), np.concatenate(parity)


def _lists(x: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(x).view(np.int64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), flat)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, bands, parity) of (doc_id, text); f1, f2 name the set; null for empty sets."""
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("n_shingles long, f1 long, f2 long, bands array<long>, parity array<long>").fields])
    arrow = to_arrow_schema(schema)
    names = np.random.default_rng(11).integers(0, 1 << 63, 2).astype(np.uint64)

    def run(batches):
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                sets = [shingle_set(x) for x in texts]
                full = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
                at = np.full(len(sets), -1)
                at[full] = np.arange(len(full))
                take = pa.array(at, mask=at < 0)
                if len(full):
                    kept = [sets[i] for i in full]
                    band, parity = sketches(kept)
                    f = [pa.array(np.array([mix(s ^ k).sum(dtype=np.uint64) for s in kept]).view(np.int64)) for k in names]
                    columns = [*(x.take(take) for x in f), _lists(band).take(take), _lists(parity).take(take)]
                else:
                    columns = [pa.nulls(len(sets), t) for t in list(arrow.types)[2:]]
                made = [rows.column(0), pa.array([len(s) for s in sets], pa.int64()), *columns]
                yield pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip(made, arrow.types)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    schema = T.StructType([docs.schema["doc_id"], T.StructField("set", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([rows.column(0).cast(arrow.field(0).type), pa.array([shingle_set(x).tobytes() for x in texts], pa.binary())], schema=arrow)

    return docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(run, schema)


def confirm(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets share at least `percent` hundredths of their union."""
    pairs = durable(pairs)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = durable(_sets(docs, ids))
    schema = T.StructType([docs.schema["doc_id"].__class__(n, docs.schema["doc_id"].dataType) for n in ("a", "b")])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                n = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * n >= percent * (len(x) + len(y) - n))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(i).cast(arrow.field(i).type) for i in range(2)], schema=arrow)

    both = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")), "a")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, schema)


def _possible(percent: int):
    """Whether sizes and parity bitmaps allow the similarity; never false for a pair that has it."""
    total = F.col("na") + F.col("nb")
    differ = sum((F.bit_count(F.element_at("pa", i + 1).bitwiseXOR(F.element_at("pb", i + 1))) for i in range(1, PARITY_WORDS)), F.bit_count(F.element_at("pa", 1).bitwiseXOR(F.element_at("pb", 1))))
    return (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (differ * (100 + percent) <= (100 - percent) * total)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, bands: int = BANDS) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row.

    Texts without words, and null texts, have no shingles and belong to nothing but themselves.
    A component is named by its smallest key; `kept` marks the rows with that key, so rows that
    repeat key and text are kept or dropped together. Keys should name one text each. Other
    columns are left out.
    """
    docs = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    sig = durable(signatures(docs))
    reps = durable(sig.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")))
    own = sig.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "n_shingles", "bands", "parity").dropDuplicates(["rep"])
    own = durable(own)
    small = own.select("rep", "n_shingles", "parity")
    first, second = F.slice("bands", 1, bands), F.slice("bands", bands + 1, bands)
    tables = F.flatten(F.transform(first, lambda x, i: F.transform(second, lambda y, j: F.xxhash64(x, y, i * bands + j))))
    keyed = own.select("rep", F.explode(tables).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = durable(keyed.join(shared, "key"))
    side = lambda n: small.select(F.col("rep").alias(n), F.col("n_shingles").alias(f"n{n}"), F.col("parity").alias(f"p{n}"))
    star = met.where("rep != leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    star = star.join(side("b"), "b").join(side("a"), "a").where(_possible(percent)).select("a", "b")
    edges = durable(confirm(docs, star, percent))
    found = connected_components(edges)
    named = met.where("n > 2").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "leader", F.coalesce("component", "rep").alias("c"))
    open_keys = named.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 != c1").select("key")
    rest = durable(named.join(open_keys, "key", "left_semi").join(small, "rep"))
    x = rest.where("rep != leader").select("key", F.col("rep").alias("a"), F.col("c").alias("ca"), F.col("n_shingles").alias("na"), F.col("parity").alias("pa"))
    y = rest.select("key", F.col("rep").alias("b"), F.col("c").alias("cb"), F.col("n_shingles").alias("nb"), F.col("parity").alias("pb"))
    more = x.join(y, "key").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _possible(percent)).select("a", "b").distinct()
    more = durable(confirm(docs, more, percent))
    if not more.isEmpty():
        found = connected_components(edges.unionAll(more))
    out = sig.select("doc_id", "n_shingles", "f1", "f2").join(reps, ["f1", "f2"], "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select(F.col("doc_id").alias(key), "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
