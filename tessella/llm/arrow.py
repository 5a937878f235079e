"""Small helpers for operators that run over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.session import durable

#: Characters of text worked on at once inside a task; bounds the memory of a slice.
SLICE_CHARS = 2_000_000


def slices(batch: pa.RecordBatch, column: str, chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """(rows, their texts) of a batch, about `chars` characters at a time; a longer text comes alone."""
    texts, at, size, held = batch.column(column), 0, 0, []
    for i, x in enumerate(texts):
        x = x.as_py()
        held.append(x)
        size += len(x or "")
        if size >= chars:
            yield batch.slice(at, i + 1 - at), held
            at, size, held = i + 1, 0, []
    if held:
        yield batch.slice(at), held


def numbered(rows: DataFrame) -> DataFrame:
    """`rows` with `key` as a struct of an own number and the key, written down so that numbers stay; rows with equal or null keys stay apart."""
    own = F.struct(F.monotonically_increasing_id().alias("row"), F.col("key"))
    return durable(rows.select(*[own.alias(c) if c == "key" else F.col(c) for c in rows.columns]))


def map_texts(df: DataFrame, text: str, added: str, fn: Callable[[list], list[list]], keep: list[str] | None = None) -> DataFrame:
    """`keep` columns of `df` (all but `text` unless given) and the columns `added`, which `fn` makes of a list of texts.

    `fn` gives one list for each added column. An added name replaces a column of the same name.
    """
    new = T._parse_datatype_string(added)
    names = [c for c in (keep if keep is not None else [c for c in df.columns if c != text]) if c not in new.names]
    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)], F.col(f"`{text}`").cast("string").alias("t"))
    schema = T.StructType([*[source.schema[f"k{i}"] for i in range(len(names))], *new.fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for rows, texts in slices(batch, "t"):
                made = fn(texts)
                columns = [*(rows.column(i).cast(arrow.field(i).type) for i in range(len(names))), *(pa.array(x, arrow.field(len(names) + i).type) for i, x in enumerate(made))]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], *new.names)
