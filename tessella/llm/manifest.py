"""A Merkle manifest of a table: leaf digests, a root for each group and for all, and a proof for each row.

Nodes of a level are rows (group, position, digest). Lag and lead columns of fixed offsets, masked
by a node's slot in its run and the run's length, are its siblings; the first row of a run hashes
its own digest and its siblings' to the parent. Runs are cut on positions, so a window spans a block
of whole runs and not a group. Each level is a sixteenth of the one below. Proofs go top down: a
node's proof is its siblings and then its parent's proof.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.positions import positions
from tessella.session import durable

FAN_OUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Runs of a block, which one window sorts.
BLOCK_RUNS = 16
#: Fixed value: upper-case Latin letters and what they become.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the concatenated parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else the value's UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _hex(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def _level(nodes: DataFrame, fan: int) -> DataFrame:
    """`nodes` (g, pos, n, d, more) with `left` and `right`, the digests of a node's siblings in a row, as bytes."""
    block = Window.partitionBy("g", F.expr(f"pos div {fan * BLOCK_RUNS}")).orderBy("pos")
    slot = F.col("pos") % fan
    run = F.least(F.lit(fan).cast("long"), F.col("n") - F.col("pos") + slot)
    empty = F.lit(b"")
    before = [F.when(slot >= k, F.lag("d", k).over(block)).otherwise(empty) for k in range(fan - 1, 0, -1)]
    after = [F.when(slot + k < run, F.lead("d", k).over(block)).otherwise(empty) for k in range(1, fan)]
    return nodes.withColumns({"left": F.concat(*before), "right": F.concat(*after)})


def _tree(nodes: DataFrame, fan: int) -> list[DataFrame]:
    """The levels over `nodes` (g, pos, n, d, more), each written down; a node that is alone in its group has no parent."""
    levels = []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        level = durable(_level(nodes, fan))
        levels.append(level)
        if most <= 1:
            return levels
        first = level.where((F.col("n") > 1) & (F.col("pos") % fan == 0))
        parent = F.unhex(digest(_hex(F.col("d")), _hex(F.col("right"))))
        nodes = first.select("g", F.expr(f"pos div {fan}").alias("pos"), F.expr(f"(n + {fan - 1}) div {fan}").alias("n"), parent.alias("d"))
        most = -(-most // fan)


def _tops(levels: list[DataFrame]) -> DataFrame:
    """(g, d): the one node that remains of each group."""
    tops = [x.where("n = 1").select("g", "d") for x in levels]
    return functools.reduce(DataFrame.unionAll, tops)


def _down(levels: list[DataFrame], tops: DataFrame, fan: int) -> DataFrame:
    """The lowest level's nodes with the columns of `tops` (g, chain, more); a chain holds the siblings from a node's level up.

    A level is joined to the one above by run, so a join's key has `fan` rows at most.
    """
    above, carried = None, [c for c in tops.columns if c not in {"g", "chain"}]
    for level in reversed(levels):
        last = level is levels[0]
        own = ["g", "pos", *(c for c in level.columns if last and c not in {"g", "pos", "n", "left", "right"})]
        here = level.where("n = 1").select(*own).join(tops, "g").select(*own, *carried, "chain")
        if above is not None:
            up = above.select("g", F.col("pos").alias("_up"), *carried, F.col("chain").alias("_chain"))
            many = level.where("n > 1").withColumn("_up", F.expr(f"pos div {fan}")).join(up, ["g", "_up"])
            chain = F.concat(F.array(F.struct("left", "right")), F.col("_chain"))
            here = here.unionByName(many.select(*own, *carried, chain.alias("chain")))
        above = here if last else durable(here)
    return above


def manifest(df: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source", changed: dict[str, Column] | None = None, where: Column | None = None, fan: int = FAN_OUT) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    A leaf is the digest of its fields. In a group leaves ascend by key (nulls first; rows of one
    key by digest); while several nodes remain, every `fan` consecutive ones become the digest of
    their digests as hex text, the last run being shorter, even of one. What remains is the
    subroot; subroots, by group (null first), likewise give the root. `proof_sha256` is the digest of
    the siblings from the leaf up to the root, that of nothing for a lone row. `folded_root` goes up
    again from the leaf as it is read now: with the columns `changed` where `where` holds (null:
    not). `verified` tells whether it reaches the root. An empty table has no rows. Other columns
    are left out. Texts are read once; only digests are shuffled.
    """
    value = lambda c: F.col(f"`{c}`")
    leaf = F.unhex(digest(*[field(value(c)) for c in fields]))
    other = F.unhex(digest(*[field((changed or {}).get(c, value(c))) for c in fields]))
    name = F.coalesce(F.concat(F.lit("="), value(group).cast("string")), F.lit(""))  # null comes first
    now = F.when(F.coalesce(where, F.lit(False)), other) if where is not None else F.lit(None).cast("binary")
    light = df.select(value(key).alias("k"), name.alias("g"), leaf.alias("d"), now.alias("now"))
    placed = positions(light, ["g"], ["k", "d"]).withColumnRenamed("n_group", "n")
    levels = _tree(durable(placed.select("g", "pos", "n", "d", "k", "now")), fan)
    subroots = positions(_tops(levels), [], ["g"]).withColumnRenamed("n_group", "n")
    upper = _tree(durable(subroots.select(F.lit("").alias("g"), "pos", "n", "d", F.col("g").alias("name"))), fan)
    top = _tops(upper).select("g", F.col("d").alias("root"), F.array().cast("array<struct<left:binary,right:binary>>").alias("chain"))
    of_group = durable(_down(upper, top, fan).select(F.col("name").alias("g"), F.col("d").alias("subroot"), "root", "chain"))
    rows = _down(levels, of_group, fan)
    folded = F.aggregate("chain", _hex(F.coalesce("now", "d")), lambda at, x: digest(_hex(x["left"]), at, _hex(x["right"])))
    siblings = F.array_join(F.transform("chain", lambda x: _hex(F.concat(x["left"], x["right"]))), "")
    out = rows.select(F.col("k").alias(key), _hex(F.col("d")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"), digest(siblings).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered(text: Column) -> Column:
    """`text` with A-Z in lower case and nothing else changed."""
    return F.translate(text, UPPER, LOWER)
