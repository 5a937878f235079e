"""Shards by ranges of a Hilbert curve through several metadata columns, with DataFrame functions only.

Each column is quantised into 2^bits ranges of about as many rows each, so a cell of the grid is a
box of metadata. Rows are sorted by the place of their cell on the curve, which keeps
neighbouring boxes together, and the order is cut into runs. A run spans a small part of every
column at once, so the least and largest values of a shard exclude it from most filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.positions import bin_of, depth_bounds, positions
from tessella.session import durable

BITS = 5
DIMENSIONS = ("source", "lang", "n_chars")
LAWS = ("rows", "bytes")


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """The place of the cell `axes` (numbers of `bits` bits) on the Hilbert curve, as a long.

    The transform of Skilling (2004): undo the rotations from the highest bit down, then take the
    Gray code. The cell is the state of one fold over (bit, axis), so that each step reads a
    bound variable and not a copy of all steps before it.
    """
    long, power = lambda v: F.lit(v).cast("long"), lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)
    steps = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(len(axes))])

    def turned(x: Column, step: Column) -> Column:
        low, own = power(step["b"]) - 1, F.get(x, step["i"])
        on = own.bitwiseAND(power(step["b"])) != 0
        change = F.get(x, F.lit(0)).bitwiseXOR(own).bitwiseAND(low)
        return F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(F.when(on, low).otherwise(change))).when((j == step["i"]) & ~on, v.bitwiseXOR(change)).otherwise(v))

    def place(x: Column) -> Column:
        gray = []
        for i in range(len(axes)):
            v = F.get(x, F.lit(i))
            gray.append(gray[-1].bitwiseXOR(v) if gray else v)
        flip, index = long(0), long(0)
        for b in range(bits - 1, 0, -1):
            flip = flip.bitwiseXOR(F.when(gray[-1].bitwiseAND(long(1 << b)) != 0, long((1 << b) - 1)).otherwise(long(0)))
        for b in range(bits):
            for i, g in enumerate(gray):
                bit = F.shiftright(g.bitwiseXOR(flip), b).bitwiseAND(long(1))
                index = index.bitwiseOR(F.shiftleft(bit, len(axes) * b + len(axes) - 1 - i))
        return index

    cell = F.array(*[a.cast("long") for a in axes])
    state = F.aggregate(steps, cell, turned) if bits > 1 else cell
    return F.get(F.transform(F.array(state), place), F.lit(0))


def on_curve(rows: DataFrame, dimensions: list[str], bits: int = BITS, name: str = "curve") -> DataFrame:
    """`rows`, which should be written down already, with `name`, the place on the curve through `dimensions`."""
    axes = [bin_of(F.col(d), depth_bounds(rows, d, 1 << bits)) for d in dimensions]
    return rows.withColumn(name, hilbert_index(axes, bits))


def run_of(law: str, shards: int) -> Column:
    """The shard of a row from `pos`, `n_group`, or `ahead`, `all_size`."""
    if law == "rows":  # the first shards have one row more where they don't come out even
        most = F.expr(f"(n_group div {shards} + 1) * (n_group % {shards})")
        even = F.expr(f"n_group % {shards} + (pos - (n_group div {shards} + 1) * (n_group % {shards})) div greatest(n_group div {shards}, 1)")
        return F.when(F.col("pos") < most, F.expr(f"pos div (n_group div {shards} + 1)")).otherwise(even).cast("int")
    return F.expr(f"CAST((ahead * {shards}) div all_size AS int)")


def shard_documents(df: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, shards: int = 8, law: str = "rows", key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard, and d0, d1, ...: the dimensions) of every row.

    Rows are sorted by the place on the curve, then by key, size and checksum, and cut into `shards`
    runs. Law `rows`: counts differ by one at most. Law `bytes`: a row goes to shard
    shards * (bytes ahead of it) div (all bytes), so a shard is off an even part by one row at most.
    `slot` counts the rows of a shard from 0. `size` is the text's UTF-8 bytes and 1; a null text
    has none and the checksum 0. Null dimensions come first; null and repeated keys are rows like
    others. `grown_shard` is null: a new cut moves rows between any shards. A dimension takes
    at most 2^bits bounds to the driver; texts are read once and never shuffled.
    """
    if law not in LAWS:
        raise ValueError(f"law must be one of {LAWS}")
    body = F.col(f"`{text}`").cast("string")
    dims = [f"d{i}" for i in range(len(dimensions))]
    light = df.select(
        F.col(f"`{key}`").alias("k"), (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
        *[F.col(f"`{c}`").alias(d) for d, c in zip(dims, dimensions)],
    )
    placed = positions(on_curve(durable(light), dims), [], ["curve", "k", "size", "text_crc32"], "size" if law == "bytes" else None)
    cut = durable(placed.withColumn("shard", run_of(law, shards)))
    starts = cut.groupBy("shard").agg(F.min("pos").alias("_start"))  # one row a shard
    out = cut.join(F.broadcast(starts), "shard")
    slot = (F.col("pos") - F.col("_start")).alias("slot")
    return out.select(F.col("k").alias(key), "size", "text_crc32", F.lit(law).alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"), *dims)


def shard_ranges(sharded: DataFrame) -> DataFrame:
    """(shard, rows, bytes, low_di, high_di): what a reader needs to leave shards out; nulls of a dimension are counted in nulls_di."""
    dims = [c for c in sharded.columns if c[0] == "d" and c[1:].isdigit()]
    each = [f(d).alias(f"{n}_{d}") for d in dims for n, f in (("low", F.min), ("high", F.max), ("nulls", lambda d: F.count_if(F.col(d).isNull())))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *each)
