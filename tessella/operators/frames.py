"""Frame jobs: one frame per row, NumPy on the pixels, Spark for everything around.

Frames are (image_id, height, width, pixels) with uint8 RGB bytes. A job is a map over
Arrow batches, a few frames at a time; plans (which tile, crop or mosaic quadrant) are
rows made by Spark, so work is spread before any pixel is touched.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.schema import FRAME, TILE_PIXELS

# Luma weights in 16-bit fixed point, channel statistics of the usual encoder.
LUMA = (19595, 38470, 7471)
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)

# Corruption strengths, light to severe.
CORRUPTIONS = {
    "illum_gradient": (0.15, 0.30, 0.50),
    "vignette": (0.20, 0.40, 0.60),
    "brightness": (0.85, 0.70, 0.55),
    "contrast": (1.30, 1.60, 2.00),
    "defocus": (1.00, 2.00, 3.50),
    "sensor_noise": (5.00, 12.0, 25.0),
}
ENCODED_BYTES = 4 << 20  # bytes of tiles an encoder sees at once
STACK_BYTES = 4 << 20  # bytes of floating-point pixels that are worked on at once
HELD_BYTES = 16 << 20  # bytes of pixels a task gathers before it passes them on
TRANSFORMS = ("identity", "rot90", "rot180", "rot270", "hflip", "vflip")


# ---- pixels in and out -----------------------------------------------------------


def pixels_of(row) -> np.ndarray:
    return np.frombuffer(row.pixels, dtype=np.uint8).reshape(row.height, row.width, 3)


def to_uint8(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0, 255).astype(np.uint8)


def stacks(b: pa.RecordBatch, frame_bytes: Callable[[int, int], int] = lambda h, w: 24 * h * w, limit: int = STACK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, (n, h, w, 3) pixels): frames of one size together, as many as take `limit` bytes."""
    h, w = (b.column(c).to_numpy(zero_copy_only=False) for c in ("height", "width"))
    pixels = b.column("pixels")
    for height, width in sorted(set(zip(h.tolist(), w.tolist()))):
        at, step = np.flatnonzero((h == height) & (w == width)), max(1, limit // max(1, frame_bytes(height, width)))
        for i in range(0, len(at), step):
            part = at[i : i + step]
            yield part, np.frombuffer(b"".join(pixels[j].as_py() for j in part), dtype=np.uint8).reshape(-1, height, width, 3)


@F.arrow_udf(T.LongType())
def weighted_sum(pixels: pa.Array) -> pa.Array:
    """Sum of the bytes, each weighted by (position mod 251) + 1; null for null."""
    out = np.zeros(len(pixels), dtype=np.int64)
    size = pixels.fill_null(b"").to_pylist()
    lengths = np.array([len(x) for x in size], dtype=np.int64)
    for n in np.unique(lengths[lengths > 0]):
        weight, at = (np.arange(n) % 251 + 1).astype(np.float64), np.flatnonzero(lengths == n)  # whole numbers below 2^53
        for part in np.split(at, range(max(1, STACK_BYTES // (8 * int(n))), len(at), max(1, STACK_BYTES // (8 * int(n))))):
            out[part] = np.frombuffer(b"".join(size[i] for i in part), dtype=np.uint8).reshape(len(part), n) @ weight
    return pa.array(out, pa.int64(), mask=np.asarray(pixels.is_null()))


def map_frames(frames: DataFrame, fn: Callable[[object], Iterator[dict]], schema: T.StructType) -> DataFrame:
    """Run `fn(row)` on every frame row; it yields output rows as dicts."""
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, held = [], 0
            for row in pdf.itertuples(index=False):
                made = list(fn(row))
                out += made
                held += sum(len(r.get("pixels", b"")) for r in made)
                if held > HELD_BYTES or len(out) > 4096:  # large frames leave one by one
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)

    return frames.mapInPandas(run, schema)


def per_frame(frames: DataFrame, fn: Callable[[np.ndarray, object], np.ndarray]) -> DataFrame:
    """Frames to frames; extra columns stay."""
    schema = frames.schema

    def one(row):
        out = np.ascontiguousarray(fn(pixels_of(row), row))
        yield {**row._asdict(), "height": out.shape[0], "width": out.shape[1], "pixels": out.tobytes()}

    return map_frames(frames, one, schema)


def pixel_values(frames: DataFrame) -> Column:
    """The pixel bytes as an array of integers, inside the JVM."""
    digits = F.hex("pixels")
    return F.transform(
        F.sequence(F.lit(0), F.octet_length("pixels") - 1),
        lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int"),
    )


def pixels_from_values(values: Column) -> Column:
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("bigint")), 2, "0")), ""))


def decode_frames(spark, root: str, recursive: bool = True) -> DataFrame:
    """(path, height, width, pixels) of the images below `root`.

    Decoding is the built-in image source; it delivers BGR, which the map turns into RGB.
    """
    reader = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", recursive)
    return rgb_frames(reader.load(root))


def rgb_frames(source: DataFrame) -> DataFrame:
    """Rows of the image source (batch or stream) as (path, height, width, pixels)."""
    raw = source.select(
        F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"),
    )
    schema = T.StructType([T.StructField("path", T.StringType()), *FRAME.fields[1:]])

    def rgb(row):
        a = np.frombuffer(row.data, dtype=np.uint8).reshape(row.height, row.width, row.channels)
        a = np.repeat(a, 3, axis=2) if row.channels == 1 else a[:, :, 2::-1]
        yield {"path": row.path, "height": row.height, "width": row.width, "pixels": np.ascontiguousarray(a).tobytes()}

    return map_frames(raw, rgb, schema)


# ---- tiling ----------------------------------------------------------------------


def grid_offsets(dim: Column, size: int, n: int) -> Column:
    """Top-left coordinates of n tiles spanning [0, dim): round(i * (dim - size) / (n - 1)),
    half to even; one centred tile for n <= 1; an error when the tile does not fit."""
    span = dim - F.lit(size)
    if n <= 1:
        cells = F.array(F.floor(span / 2).cast("int"))
    else:
        cells = F.transform(
            F.sequence(F.lit(0), F.lit(n - 1)),
            lambda i: F.bround((i * span).cast("double") / float(n - 1), 0).cast("int"),
        )
    message = F.concat(F.lit("image dimension "), dim.cast("string"), F.lit(f" is smaller than the tile size {size}"))
    return F.when(dim < size, F.raise_error(message).cast("array<int>")).otherwise(cells)


def tile_plan(frames: DataFrame, size: int, n: int) -> DataFrame:
    """(image_id, tile_idx, y, x, size) row-major, without touching pixels."""
    ys = F.posexplode(grid_offsets(F.col("height"), size, n)).alias("_r", "y")
    xs = F.posexplode(grid_offsets(F.col("width"), size, n)).alias("_c", "x")
    rows = frames.select("image_id", "width", ys).select("image_id", "_r", "y", xs)
    return rows.select("image_id", (F.col("_r") * n + F.col("_c")).cast("int").alias("tile_idx"), "y", "x", F.lit(size).alias("size"))


def _offsets(dim: int, size: int, n: int) -> list[int]:
    if dim < size:
        raise ValueError(f"image dimension {dim} is smaller than the tile size {size}")
    return [(dim - size) // 2] if n <= 1 else [round(i * (dim - size) / (n - 1)) for i in range(n)]


def cut(a: np.ndarray, size: int, n: int) -> np.ndarray:
    """(n * n, size, size, 3) row-major tiles of one frame; of stacked ones, those of the first frame first."""
    h, w = a.shape[-3:-1]
    tiles = np.stack([a[..., y : y + size, x : x + size, :] for y in _offsets(h, size, n) for x in _offsets(w, size, n)], axis=-4)
    return tiles.reshape(-1, *tiles.shape[-3:])


def grid_tiles(frames: DataFrame, size: int, n: int) -> DataFrame:
    """Deterministic n x n tiles with their pixels."""

    def one(row):
        a = pixels_of(row)
        ys, xs = _offsets(row.height, size, n), _offsets(row.width, size, n)
        for i, (y, x) in enumerate((y, x) for y in ys for x in xs):
            yield dict(image_id=row.image_id, tile_idx=i, y=y, x=x, size=size, pixels=np.ascontiguousarray(a[y : y + size, x : x + size]).tobytes())

    return map_frames(frames, one, TILE_PIXELS)


def draw(*parts: Column | str | int) -> Column:
    """A whole number of 32 bits from the md5 of `parts`; SQL can draw the same."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def random_plan(frames: DataFrame, size: int, per_image: int, seed: int, hflip: bool = True, vflip: bool = True) -> DataFrame:
    """(frame columns, tile_idx, y, x, fx, fy): uniform corners and flips, drawn per tile without touching pixels."""
    rows = frames.withColumn("tile_idx", F.explode(F.sequence(F.lit(0), F.lit(per_image - 1))))
    one = lambda what: draw(F.col("image_id"), F.col("tile_idx"), what, seed)
    fits = F.least("height", "width") >= size
    small = F.raise_error(F.concat(F.lit(f"no tile of {size} fits into image "), F.col("image_id").cast("string"))).cast("bigint")
    corner = lambda what, dim: F.when(fits, F.pmod(one(what), F.col(dim) - size + 1)).otherwise(small).cast("int")
    flip = lambda what, on: (one(what) % 2 == 1) & F.lit(on)
    return rows.withColumns({"y": corner("y", "height"), "x": corner("x", "width"), "fx": flip("fx", hflip), "fy": flip("fy", vflip)})


def random_tiles(frames: DataFrame, size: int, per_image: int, seed: int, hflip: bool = True, vflip: bool = True) -> DataFrame:
    """Uniform crops with optional flips. Draws depend on image, tile and seed alone."""
    of = random_plan(frames.select("image_id", "height", "width"), size, per_image, seed, hflip, vflip)
    plans = of.groupBy("image_id").agg(F.collect_list(F.struct("tile_idx", "y", "x", "fx", "fy")).alias("plan"))  # `per_image` entries

    def one(row):
        a = pixels_of(row)
        for p in row.plan:
            t = a[p["y"] : p["y"] + size, p["x"] : p["x"] + size][:: -1 if p["fy"] else 1, :: -1 if p["fx"] else 1]
            yield dict(image_id=row.image_id, tile_idx=p["tile_idx"], y=p["y"], x=p["x"], size=size, pixels=np.ascontiguousarray(t).tobytes())

    return map_frames(frames.join(plans, "image_id"), one, TILE_PIXELS)


# ---- linear filters as one matrix per axis ----------------------------------------


def _triangle(x):
    return np.maximum(0.0, 1.0 - np.abs(x))


def _cubic(x, a=-0.5):
    x = np.abs(x)
    near = (a + 2) * x**3 - (a + 3) * x**2 + 1
    far = a * x**3 - 5 * a * x**2 + 8 * a * x - 4 * a
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


@functools.lru_cache(maxsize=512)
def resize_matrix(n: int, m: int, kernel: str = "bilinear", antialias: bool = True) -> np.ndarray:
    """(m, n) resampling weights with pixel-centre alignment; rows sum to one. Frames of one size share them."""
    fn, support = (_triangle, 1.0) if kernel == "bilinear" else (_cubic, 2.0)
    scale = max(n / m, 1.0) if antialias else 1.0
    centre = (np.arange(m) + 0.5) * n / m - 0.5
    if not antialias:  # sample positions are clamped to the image
        centre = np.clip(centre, 0, n - 1)
    w = fn((np.arange(n)[None, :] - centre[:, None]) / scale)
    w[np.abs(np.arange(n)[None, :] - centre[:, None]) > support * scale] = 0.0
    return w / w.sum(axis=1, keepdims=True)


def gaussian_matrix(n: int, sigma: float, border: str) -> np.ndarray:
    """(n, n) Gaussian blur. `reflect` mirrors at the edge with radius 4 sigma; `zero` pads
    with zeros with radius 3 sigma, so its rows lose mass near the edge."""
    radius = int(4.0 * sigma + 0.5) if border == "reflect" else max(1, int(round(3.0 * sigma)))
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    k /= k.sum()
    out = np.zeros((n, n))
    for j, w in zip(range(-radius, radius + 1), k):
        at = np.arange(n) + j
        if border == "reflect":
            period = at % (2 * n)
            at = np.where(period < n, period, 2 * n - 1 - period)
            np.add.at(out, (np.arange(n), at), w)
        else:
            ok = (at >= 0) & (at < n)
            out[np.arange(n)[ok], at[ok]] += w
    return out


@functools.lru_cache(maxsize=32)
def background_factors(n: int, sigma: float, downsample: int, border: str) -> tuple[np.ndarray, ...]:
    """The filters along one axis, in the order of use: shrink, blur, grow. Frames of one size share them."""
    if downsample <= 1:
        return (gaussian_matrix(n, sigma, border),)
    small = max(1, n // downsample)
    shrink = resize_matrix(n, small, antialias=border == "reflect")
    return shrink, gaussian_matrix(small, max(sigma / downsample, 0.5), border), resize_matrix(small, n)


def both_axes(a: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Frames, one or stacked, each as if alone."""
    *many, h, w, c = a.shape
    x = np.matmul(rows, a.astype(np.float64).reshape(*many, h, w * c)).reshape(*many, -1, w, c)
    return np.matmul(cols, x)


def background_of(a: np.ndarray, sigma: float, downsample: int, border: str) -> np.ndarray:
    h, w = a.shape[-3:-1]
    for rows, cols in zip(background_factors(h, sigma, downsample, border), background_factors(w, sigma, downsample, border)):
        a = both_axes(a, rows, cols)
    return a


def flatten_of(a: np.ndarray, method: str, sigma: float = 64.0, downsample: int = 8, border: str = "reflect", eps: float = 1.0) -> np.ndarray:
    """Illumination-corrected float pixels in [0, 255] of a frame or of stacked ones."""
    if method not in ("divide", "subtract", "none"):
        raise ValueError(f"no illumination method is called {method!r}")
    if method == "none":
        return a.astype(np.float64)
    bg = background_of(a, sigma, downsample, border)
    mean = bg.reshape(*a.shape[:-3], -1).mean(axis=-1)[..., None, None, None]
    out = a / (bg + eps) * mean if method == "divide" else a - bg + mean
    return np.clip(out, 0, 255)


def background(frames: DataFrame, sigma: float = 64.0, downsample: int = 8, border: str = "reflect") -> DataFrame:
    """(image_id, c, mean, lo, hi) of the estimated background per channel."""
    schema = T.StructType([FRAME.fields[0], *[T.StructField(n, t) for n, t in (("c", T.IntegerType()), ("mean", T.DoubleType()), ("lo", T.DoubleType()), ("hi", T.DoubleType()))]])

    def one(row):
        bg = background_of(pixels_of(row), sigma, downsample, border)
        for c in range(3):
            yield dict(image_id=row.image_id, c=c, mean=bg[..., c].mean(), lo=bg[..., c].min(), hi=bg[..., c].max())

    return map_frames(frames, one, schema)


def flatten_illumination(frames: DataFrame, method: str = "divide", sigma: float = 64.0, downsample: int = 8, border: str = "reflect") -> DataFrame:
    return per_frame(frames, lambda a, _: to_uint8(flatten_of(a, method, sigma, downsample, border)))


# ---- corruptions and transforms ---------------------------------------------------


def corrupted(a: np.ndarray, name: str, severity: int, image_id=0) -> np.ndarray:
    """A frame, or stacked ones with an array of ids, under one condition."""
    if name == "clean":
        return a
    s = CORRUPTIONS[name][severity - 1]
    x, (h, w) = a.astype(np.float64), a.shape[-3:-1]
    if name == "illum_gradient":
        x = x * np.linspace(1.0 - s, 1.0 + s, w)[None, :, None]
    elif name == "vignette":
        r2 = np.linspace(-1, 1, h)[:, None] ** 2 + np.linspace(-1, 1, w)[None, :] ** 2
        x = x * (1.0 - s * r2 / 2.0)[..., None]
    elif name == "brightness":
        x = x * s
    elif name == "contrast":
        x = ((np.arange(256) / 255.0) ** s * 255.0)[a]
    elif name == "defocus":
        x = both_axes(x, gaussian_matrix(h, s, "zero"), gaussian_matrix(w, s, "zero"))
    else:
        code, shape = zlib.crc32(name.encode()), a.shape[-3:]
        noise = [np.random.default_rng([int(i), severity, code]).standard_normal(shape) for i in np.atleast_1d(image_id)]
        x = x + s * np.stack(noise).reshape(a.shape)
    return to_uint8(x)


def conditions(spark) -> DataFrame:
    """(corruption, severity): the clean condition and every corruption at three strengths."""
    rows = [("clean", 0)] + [(n, s) for n in CORRUPTIONS for s in (1, 2, 3)]
    return spark.createDataFrame(rows, "corruption string, severity int")


def corrupt(frames: DataFrame, names: Sequence[tuple[str, int]] | None = None) -> DataFrame:
    """Every frame under every condition, with `corruption` and `severity` columns.

    Frames are neither shuffled nor copied before the map: it works on stacked frames, condition by condition."""
    todo = list(names) if names is not None else [("clean", 0)] + [(n, s) for n in CORRUPTIONS for s in (1, 2, 3)]
    kept = [c for c in frames.columns if c != "pixels"]
    schema = T.StructType([*frames.schema.fields, T.StructField("corruption", T.StringType()), T.StructField("severity", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, a in stacks(b):
                ids, n = b.column("image_id").to_numpy(zero_copy_only=False)[at], len(at)
                own = {c: b.column(c).take(pa.array(at)) for c in kept}
                for name, severity in todo:
                    made = {"pixels": pa.array([x.tobytes() for x in corrupted(a, name, severity, ids)], pa.binary()),
                            "corruption": pa.array([name] * n), "severity": pa.array(np.full(n, severity, np.int32))}
                    yield pa.RecordBatch.from_arrays([(own | made)[c] for c in schema.names], names=schema.names)

    return frames.mapInArrow(run, schema)


def resized(a: np.ndarray, h: int, w: int, kernel: str = "bilinear", antialias: bool = False) -> np.ndarray:
    rows, cols = resize_matrix(a.shape[0], h, kernel, antialias), resize_matrix(a.shape[1], w, kernel, antialias)
    return to_uint8(both_axes(a, rows, cols) + (0.5 if antialias else 0.0))


def resize_frames(frames: DataFrame, size: int, kernel: str = "bilinear", antialias: bool = False) -> DataFrame:
    """Whole frames to size x size."""
    return per_frame(frames, lambda a, _: resized(a, size, size, kernel, antialias))


def grayscale_of(a: np.ndarray) -> np.ndarray:
    luma = (a.astype(np.int64) @ np.array(LUMA) + 0x8000) >> 16
    return np.repeat(luma.astype(np.uint8)[..., None], 3, axis=-1)


def transformed(a: np.ndarray, name: str) -> np.ndarray:
    """A frame, or frames of one size, under a named transform."""
    if name.startswith("rot"):
        return np.rot90(a, int(name[3:]) // 90, axes=(-3, -2))
    return {"identity": lambda x: x, "hflip": lambda x: x[..., ::-1, :], "vflip": lambda x: x[..., ::-1, :, :], "grayscale": grayscale_of}[name](a)


def transform_frames(frames: DataFrame, names: Sequence[str] = TRANSFORMS) -> DataFrame:
    """Every frame under every named transform, with a `transform` column."""
    rows = frames.withColumn("transform", F.explode(F.array(*[F.lit(n) for n in names])))
    return per_frame(rows, lambda a, r: transformed(a, r.transform))


# ---- augmentation ----------------------------------------------------------------


def augment_plan(frames: DataFrame, multiplier: int = 5, min_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """(frame columns, aug_idx, angle, side, oy, ox): rotated square crops that no pixel from outside enters.

    A square of side s at angle t spans s (|cos t| + |sin t|) along both axes. With b the
    largest span over the smallest side, every angle within w of a multiple of 90 degrees
    fits: w is 45 where b >= sqrt 2, else 45 - acos(b / sqrt 2), and 0 where b <= 1. The
    angle is uniform there, the side uniform up to the largest that fits, and the centre
    uniform over the places at which the span stays inside.
    """
    rows = frames.withColumn("aug_idx", F.explode(F.sequence(F.lit(0), F.lit(multiplier - 1))))
    u = lambda what: draw(F.col("image_id"), F.col("aug_idx"), what, seed) / F.lit(float(1 << 32))
    room = (F.least("height", "width") - 2).cast("double")
    least = F.least(F.ceil(F.sqrt(F.col("height").cast("double") * F.col("width") * min_ratio)), room)
    b = F.least(F.lit(math.sqrt(2.0)), F.greatest(F.lit(1.0), room / least))
    rows = rows.withColumns({"_room": room, "_least": least, "_w": 45.0 - F.degrees(F.acos(b / math.sqrt(2.0)))})
    rows = rows.withColumn("angle", F.pmod(F.floor(u("quarter") * 4) * 90.0 + (u("angle") * 2 - 1) * F.col("_w"), F.lit(360.0)))
    rows = rows.withColumn("_span", F.abs(F.cos(F.radians("angle"))) + F.abs(F.sin(F.radians("angle"))))
    most = F.greatest(F.col("_least"), F.floor(F.col("_room") / F.col("_span") + 1e-9))
    rows = rows.withColumn("side", (F.col("_least") + F.floor(u("side") * (most - F.col("_least") + 1))).cast("int"))
    shift = lambda what, dim: (u(what) * 2 - 1) * F.greatest(F.lit(0.0), (F.col(dim) - 1 - F.col("side") * F.col("_span")) / 2)
    return rows.withColumns({"oy": shift("oy", "height"), "ox": shift("ox", "width")}).drop("_room", "_least", "_w", "_span")


def gather(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values at real positions, clamped to the frame."""
    low = [np.clip(np.floor(p), 0, n - 2).astype(int) for p, n in ((y, a.shape[0]), (x, a.shape[1]))]
    v, u = (np.clip(p - i, 0.0, 1.0)[..., None] for p, i in zip((y, x), low))
    flat, at = a.reshape(-1, a.shape[2]).astype(np.float64), low[0] * a.shape[1] + low[1]
    corner = lambda di, dj: flat.take(at + (di * a.shape[1] + dj), axis=0)
    return (1 - v) * ((1 - u) * corner(0, 0) + u * corner(0, 1)) + v * ((1 - u) * corner(1, 0) + u * corner(1, 1))


def crop_at(a: np.ndarray, angle: float, side: int, oy: float, ox: float) -> np.ndarray:
    """The square of `side` around the frame's centre plus (oy, ox), turned by `angle` degrees."""
    step = np.arange(side) - (side - 1) / 2.0
    turn = np.exp(1j * math.radians(angle)) * (step[None, :] + 1j * step[:, None])
    h, w = a.shape[:2]
    return to_uint8(np.rint(gather(a, turn.imag + (h - 1) / 2.0 + oy, turn.real + (w - 1) / 2.0 + ox)))


def augment_todo(images: DataFrame, existing: DataFrame, multiplier: int) -> DataFrame:
    """Classes to redo: those with fewer than multiplier x images outputs (combo, n, have)."""
    n = images.groupBy("combo").agg(F.count("*").alias("n"))
    have = existing.groupBy("combo").agg(F.count("*").alias("have"))
    return n.join(have, "combo", "left").withColumn("have", F.coalesce("have", F.lit(0))).where(F.col("have") < F.col("n") * multiplier)


def augment(frames: DataFrame, multiplier: int = 5, min_ratio: float = 0.2, size: int | None = None, seed: int = 42) -> DataFrame:
    """`multiplier` rotated square crops of every frame, with an `aug_idx` column.

    Draws depend on (image, copy, seed) alone. Copies are rows before pixels are read, so one
    frame's crops can run in several tasks.
    """

    def crop(a, r):
        out = crop_at(a, r.angle, r.side, r.oy, r.ox)
        return resized(out, size, size, antialias=True) if size else out

    return per_frame(augment_plan(frames, multiplier, min_ratio, seed), crop).drop("angle", "side", "oy", "ox")


# ---- mosaics ---------------------------------------------------------------------


def mosaic_plan(combos: DataFrame, n_per_combo: int, seed: int, tiles: int = 16, quads: int = 4) -> DataFrame:
    """(combo, mosaic, tile_idx, quad, class): which class fills every quadrant.

    `combos` has combo and tokens. The slots of a mosaic in hash order first take every
    class once, so coverage is certain; the others are drawn uniformly.
    """
    slots = tiles * quads
    each = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    rows = combos.select("combo", "tokens", F.explode(each(n_per_combo)).alias("mosaic"))
    h = lambda i: F.md5(F.concat_ws(":", F.col("combo"), F.col("mosaic").cast("string"), i.cast("string"), F.lit(str(seed))))
    ordered = F.array_sort(F.transform(each(slots), lambda i: F.struct(h(i).alias("h"), i.alias("slot"))))
    rows = rows.select("combo", "mosaic", "tokens", F.posexplode(ordered).alias("rank", "e"))
    draw = F.conv(F.substring("e.h", 1, 8), 16, 10).cast("bigint")
    pick = F.when(F.col("rank") < F.size("tokens"), F.col("rank")).otherwise(F.pmod(draw, F.size("tokens")).cast("int"))
    return rows.select(
        "combo", "mosaic", F.floor(F.col("e.slot") / quads).cast("int").alias("tile_idx"),
        (F.col("e.slot") % quads).alias("quad"), F.col("tokens")[pick].alias("class"), F.col("e.h").alias("h"),
    )


def mosaic(pool: DataFrame, combos: DataFrame, n_per_combo: int, seed: int, quad: int = 112, copies: int = 16) -> DataFrame:
    """(combo, mosaic, tile_idx, size, pixels): tiles of four quadrants, each a random
    patch of a random pure frame of its class, drawn from the whole pool.

    `pool` holds (class, image_id, height, width, pixels). Frames are numbered per class and
    slots look theirs up by an equi-join of ids. A frame then travels with the list of its
    patches, in at most `copies` parts, so a frame that many slots want is neither sent once
    for each nor one task's whole work.
    """
    from tessella.operators.ordering import hash_rank
    from tessella.operators.splits import id_digest

    numbered = hash_rank(pool.select("class", "image_id").withColumn("_h", id_digest("image_id", seed)), ["class"], "_h", ["image_id"])
    numbered = numbered.select("class", "image_id", "pos")
    size = numbered.groupBy("class").agg(F.count("*").alias("_n"))
    part = lambda at: F.conv(F.substring("h", at, 8), 16, 10).cast("bigint")
    slots = mosaic_plan(combos, n_per_combo, seed).join(size, "class")
    slots = slots.withColumn("pos", F.pmod(part(9), F.col("_n"))).withColumn("dy", part(17)).withColumn("dx", part(25))
    want = slots.join(numbered, ["class", "pos"]).withColumn("_part", F.pmod(F.xxhash64("combo", "mosaic", "tile_idx"), F.lit(copies)))
    spot = F.struct("combo", "mosaic", "tile_idx", "quad", "dy", "dx")
    cells = want.groupBy("class", "image_id", "_part").agg(F.collect_list(spot).alias("spots")).join(pool, ["class", "image_id"])
    patch_schema = T.StructType([want.schema[c] for c in ("combo", "mosaic", "tile_idx", "quad")] + [T.StructField("pixels", T.BinaryType())])

    def patches_of(row):
        a = pixels_of(row)
        for p in row.spots:
            y, x = p["dy"] % (row.height - quad + 1), p["dx"] % (row.width - quad + 1)
            yield dict(combo=p["combo"], mosaic=p["mosaic"], tile_idx=p["tile_idx"], quad=p["quad"], pixels=np.ascontiguousarray(a[y : y + quad, x : x + quad]).tobytes())

    patches = map_frames(cells, patches_of, patch_schema)
    tiles = patches.groupBy("combo", "mosaic", "tile_idx").agg(F.array_sort(F.collect_list(F.struct("quad", "pixels"))).alias("q"))
    tile_schema = T.StructType([want.schema[c] for c in ("combo", "mosaic", "tile_idx")] + [T.StructField("size", T.IntegerType()), T.StructField("pixels", T.BinaryType())])

    def stitched(row):
        q = [np.frombuffer(p["pixels"], np.uint8).reshape(quad, quad, 3) for p in row.q]
        tile = np.concatenate([np.concatenate(q[:2], axis=1), np.concatenate(q[2:], axis=1)])
        yield dict(combo=row.combo, mosaic=row.mosaic, tile_idx=row.tile_idx, size=2 * quad, pixels=tile.tobytes())

    return map_frames(tiles, stitched, tile_schema)


# ---- encoding --------------------------------------------------------------------

Encoder = Callable[[np.ndarray], np.ndarray]  # (n, s, s, 3) normalised floats -> (n, D) or (n, 1 + P, D)


class ProjectionEncoder:
    """Seeded random projection of average-pooled pixels: a stand-in that needs no weights.

    `tokens=True` gives one leading summary token and one token per pooled cell.
    """

    def __init__(self, dim: int = 64, pool: int = 4, seed: int = 0, tokens: bool = False):
        self.dim, self.pool, self.tokens = dim, pool, tokens
        rng = np.random.default_rng(seed)
        self.whole = rng.standard_normal((dim, pool * pool * 3)) / np.sqrt(pool * pool * 3)
        self.cell = rng.standard_normal((dim, 3)) / np.sqrt(3)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        n, s = x.shape[:2]
        edge = np.linspace(0, s, self.pool + 1).astype(int)
        cells = np.stack([x[:, a:b, c:d].mean(axis=(1, 2)) for a, b in zip(edge, edge[1:]) for c, d in zip(edge, edge[1:])], axis=1)
        summary = cells.reshape(n, -1) @ self.whole.T
        return np.concatenate([summary[:, None], cells @ self.cell.T], axis=1) if self.tokens else summary


def normalize_pixels(x: np.ndarray, mean=CHANNEL_MEAN, std=CHANNEL_STD) -> np.ndarray:
    return (x / 255.0 - np.asarray(mean)) / np.asarray(std)


TILE_VECTORS = T.StructType([
    T.StructField("image_id", T.LongType()), T.StructField("tile_idx", T.IntegerType()), T.StructField("z", T.ArrayType(T.FloatType())),
])
UNIT_VECTORS = T.StructType([
    T.StructField("granularity", T.StringType()), T.StructField("image_id", T.LongType()), T.StructField("tile_idx", T.IntegerType()),
    T.StructField("z", T.ArrayType(T.FloatType())),
])


def normalize_tiles(tiles: DataFrame, mean=CHANNEL_MEAN, std=CHANNEL_STD) -> DataFrame:
    """(image_id, tile_idx, values): scaled and standardised pixels of tile rows."""
    schema = T.StructType([*TILE_VECTORS.fields[:2], T.StructField("values", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for size, part in pdf.groupby("size"):
                x = np.stack([np.frombuffer(p, dtype=np.uint8) for p in part["pixels"]]).reshape(-1, size, size, 3)
                v = normalize_pixels(x, mean, std).reshape(len(part), -1)
                yield pd.DataFrame({"image_id": part["image_id"].values, "tile_idx": part["tile_idx"].values, "values": list(v)})

    return tiles.select("image_id", "tile_idx", "size", "pixels").mapInPandas(run, schema)


def embed_tiles(tiles: DataFrame, encoder: Encoder, mean=CHANNEL_MEAN, std=CHANNEL_STD) -> DataFrame:
    """(image_id, tile_idx, z) from tile pixels.

    The encoder travels once per Python worker and sees one Arrow batch at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for size, part in pdf.groupby("size"):
                x = np.stack([np.frombuffer(p, dtype=np.uint8).reshape(size, size, 3) for p in part["pixels"]])
                z = encoder(normalize_pixels(x.astype(np.float64), mean, std)).astype(np.float32)
                yield pd.DataFrame({"image_id": part["image_id"].values, "tile_idx": part["tile_idx"].values, "z": list(z)})

    return tiles.select("image_id", "tile_idx", "size", "pixels").mapInPandas(run, TILE_VECTORS)


def embed_frames(
    frames: DataFrame, encoder: Encoder, size: int, n: int, method: str = "divide", sigma: float = 64.0, downsample: int = 8,
    border: str = "zero", preprocess: Callable[[np.ndarray], np.ndarray] | None = None, transform: Callable[[np.ndarray], np.ndarray] | None = None,
    moves: Sequence[str] = (),
) -> DataFrame:
    """Frame to tile vectors in one map: transform, flatten, tile, normalise, encode.

    `moves` names transforms of `transformed`: each frame is encoded under every one, with a `transform` column. Flattened values stay floating point, and tile pixels never leave the task. Frames of one size are
    worked on together, as many as have ENCODED_BYTES of tiles, so a task holds no more whatever its rows.
    """
    alone = lambda a, fn: np.stack([fn(x) for x in a])
    room = lambda h, w: 24 * max(h * w, n * n * size * size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("image_id").to_numpy(zero_copy_only=False)
            for at, a in stacks(b, room, ENCODED_BYTES):
                a = alone(a, transform) if transform else a
                for name in moves or (None,):
                    m = np.ascontiguousarray(transformed(a, name)) if name else a
                    x = alone(m, preprocess).astype(np.float64) if preprocess else flatten_of(m, method, sigma, downsample, border)
                    z = np.asarray(encoder(normalize_pixels(cut(x, size, n))), dtype=np.float32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
                    places = np.tile(np.arange(n * n, dtype=np.int32), len(at))
                    made = [pa.array(np.repeat(ids[at], n * n), pa.int64()), pa.array(places), lists]
                    yield pa.RecordBatch.from_arrays([*made, pa.array([name] * len(z))] if name else made, names=schema.names)

    schema = T.StructType([*TILE_VECTORS.fields, *([T.StructField("transform", T.StringType())] if moves else [])])
    return frames.select("image_id", "height", "width", "pixels").mapInArrow(run, schema)


def units_from_tokens(
    frames: DataFrame, encoder: Encoder, grids: Sequence[tuple[int, int]], kinds: Sequence[str] = ("cls", "patchmean", "patch"),
    method: str = "divide", sigma: float = 64.0, downsample: int = 8, border: str = "zero",
) -> DataFrame:
    """(granularity, image_id, tile_idx, z) of every requested kind and (tile size, grid).

    One encoder call per frame and tile size gives all kinds; `tile_idx` is the unit's
    position in row-major tile order.
    """

    def one(row):
        x = flatten_of(pixels_of(row), method, sigma, downsample, border)
        for size, n in grids:
            tok = encoder(normalize_pixels(cut(x, size, n)))
            made = {"cls": tok[:, :1], "patchmean": tok[:, 1:].mean(axis=1, keepdims=True), "patch": tok[:, 1:]}
            for kind in kinds:
                flat = made[kind].reshape(-1, tok.shape[2])
                flat = flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-12)
                for i, z in enumerate(flat.astype(np.float32)):
                    yield dict(granularity=f"{kind}{size}", image_id=row.image_id, tile_idx=i, z=z)

    return map_frames(frames.select("image_id", "height", "width", "pixels"), one, UNIT_VECTORS)
