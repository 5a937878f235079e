"""Explicit schemas of the tables the library reads and writes.

The class dimension is carried either as rows (`k`) or as an array whose order is
the class catalog; a new class never changes a schema.
"""

from pyspark.sql import types as T

ENTRY = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("label", T.ArrayType(T.IntegerType())),
        T.StructField("combo", T.StringType()),
        T.StructField("video", T.StringType()),  # older spelling of `combo`
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("class_names", T.ArrayType(T.StringType())),
        T.StructField("seed", T.LongType()),
        T.StructField("heldout_combos", T.ArrayType(T.StringType())),
        T.StructField("trained_combos", T.ArrayType(T.StringType())),
        T.StructField("splits", T.MapType(T.StringType(), T.ArrayType(ENTRY))),
    ]
)

FOLDS = T.StructType(
    [
        T.StructField("class_names", T.ArrayType(T.StringType())),
        T.StructField("heldout_test_combos", T.ArrayType(T.StringType())),
        T.StructField("trained_combos", T.ArrayType(T.StringType())),
        T.StructField(
            "folds",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("fold", T.IntegerType()),
                        T.StructField("dev_combos", T.ArrayType(T.StringType())),
                        T.StructField("train_combos", T.ArrayType(T.StringType())),
                    ]
                )
            ),
        ),
    ]
)

FRAME = T.StructType(
    [
        T.StructField("image_id", T.LongType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("pixels", T.BinaryType()),  # uint8, height x width x 3, RGB
    ]
)

TILE_PIXELS = T.StructType(
    [
        T.StructField("image_id", T.LongType()),
        T.StructField("tile_idx", T.IntegerType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("x", T.IntegerType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("pixels", T.BinaryType()),
    ]
)

TILES = T.StructType(
    [
        T.StructField("image_id", T.LongType()),
        T.StructField("tile_idx", T.IntegerType()),
        T.StructField("z", T.ArrayType(T.FloatType())),
    ]
)
