"""Continuous folder inference: every new frame is decided once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessella.operators import frames as FR
from tessella.plans.infer import frame_decisions

IMAGE_SOURCE = T.StructType([
    T.StructField("image", T.StructType([
        T.StructField("origin", T.StringType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()),
        T.StructField("nChannels", T.IntegerType()), T.StructField("mode", T.IntegerType()), T.StructField("data", T.BinaryType()),
    ]))
])


def incoming_frames(spark, root: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of (path, height, width, pixels) from image files as they appear."""
    reader = spark.readStream.format("image").schema(IMAGE_SOURCE).option("recursiveFileLookup", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return FR.rgb_frames(reader.load(root))


def stream_presence(
    spark, root: str, model, encoder: FR.Encoder, size: int, n: int, out: str, checkpoint: str,
    readout: str = "sims", available_now: bool = False, files_per_trigger: int | None = None, **embed,
) -> StreamingQuery:
    """Start the query; decisions are appended to Parquet at `out`.

    The file source remembers processed files in the checkpoint and the file sink commits
    per batch, so each frame is decided exactly once across restarts. A frame is one row
    throughout, which keeps the query stateless.
    """
    frames = incoming_frames(spark, root, files_per_trigger)
    rows = frame_decisions(frames, model, encoder, size, n, readout, **embed)
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_table(spark, path: str, schema: T.StructType, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_trigger: int | None = None) -> StreamingQuery:
    """`step` over the Parquet files at `path` as they arrive, up to those there now; start the query.

    Each micro-batch is written to a folder named by its number, which a replay writes anew,
    so a batch that is run again after a failure adds nothing. `step` must work row by row.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return reader.parquet(path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed(spark, out: str) -> DataFrame:
    """What the batches of `stream_table` wrote, with their `batch` number."""
    return spark.read.parquet(out)
