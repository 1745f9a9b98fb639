"""Image features.

A processor turns the pixels of one image into one named value. All processors of a fingerprint run
in one Arrow batch function: pixels cross to Python once, nothing is shuffled, and a plan that needs
one feature lists only that processor.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from mediamatch.schema import MAX_WORKING_EDGE

HASH_SIDE = 32
EDGE_SIDE = 64
COLOR_SIDE = 150
COLOR_BINS = 16


@dataclass(frozen=True)
class Processor:
    """`compute` maps an RGB array (height, width, 3) to a value; `blank` stands in when the pixels are unusable."""

    name: str
    dtype: T.DataType
    compute: Callable[[np.ndarray], object]
    blank: object


#: Longest side of a picture that is resampled by matrix products; beyond it the taps are few beside the pixels.
SMALL_SIDE = 128


def _taps(source: int, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.arange(target, dtype=np.int64) * (source * 256 // target)
    low = np.minimum(at >> 8, source - 1)
    return low, np.minimum(low + 1, source - 1), (at & 255).astype(np.int32)


@lru_cache(maxsize=1024)
def _tap_matrix(source: int, target: int) -> np.ndarray:
    """(source, target): the weight of each source line in each target line, in 1/256 steps."""
    low, high, share = _taps(source, target)
    out = np.zeros((source, target), np.float32)
    np.add.at(out, (low, np.arange(target)), 256 - share)
    np.add.at(out, (high, np.arange(target)), share)
    return out


def _weighted(rgb: np.ndarray, width: int, height: int) -> np.ndarray:
    """(3, height, width): resampled values of each channel times 65536.

    All sums are whole numbers below 2 ** 24, which single precision holds exactly, in whatever order they are added.
    """
    planes = np.ascontiguousarray(rgb.transpose(2, 0, 1), dtype=np.float32)
    return _tap_matrix(rgb.shape[0], height).T @ (planes @ _tap_matrix(rgb.shape[1], width))


def _is_small(rgb: np.ndarray) -> bool:
    return max(rgb.shape[:2]) <= SMALL_SIDE


def resample(rgb: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear resize on the grid anchored at the top left corner, in 1/256 steps of integer arithmetic."""
    if _is_small(rgb):
        return (_weighted(rgb, width, height) * np.float32(2**-16)).astype(np.uint8).transpose(1, 2, 0)
    y0, y1, fy = _taps(rgb.shape[0], height)
    x0, x1, fx = _taps(rgb.shape[1], width)
    fy, fx = fy[:, None, None], fx[None, :, None]
    rows = rgb[y0].astype(np.int32) * (256 - fy) + rgb[y1].astype(np.int32) * fy
    return ((rows[:, x0] * (256 - fx) + rows[:, x1] * fx) >> 16).astype(np.uint8)


def grey(rgb: np.ndarray) -> np.ndarray:
    # Luma weights in thousandths.
    red, green, blue = (rgb[:, :, c].astype(np.int32) for c in range(3))
    return np.ascontiguousarray((299 * red + 587 * green + 114 * blue) // 1000)


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    """First 8 rows of the scaled 32-point DCT basis; the scale splits 1/4 evenly over both axes."""
    u, x = np.arange(8)[:, None], np.arange(HASH_SIDE)[None, :]
    scale = np.where(u == 0, 1 / np.sqrt(2.0), 1.0) / 2
    return scale * np.cos(np.pi * (2 * x + 1) * u / (2 * HASH_SIDE))


def dct_block(rgb: np.ndarray) -> np.ndarray:
    """Low 8x8 DCT coefficients of the grey 32x32 image, first index along x."""
    basis = _cosines()
    return basis @ grey(resample(rgb, HASH_SIDE, HASH_SIDE)).T @ basis.T


def perceptual_hash(rgb: np.ndarray) -> str:
    block = dct_block(rgb).ravel()
    mean = (block.sum() - block[0]) / 63
    # A margin of 1e-6 keeps rounding noise of flat images out of the bits.
    return np.packbits(block - mean > 1e-6).tobytes().hex()


def color_histogram(rgb: np.ndarray) -> np.ndarray:
    """16 bins per channel, red then green then blue, as shares of the pixels."""
    small = resample(rgb, COLOR_SIDE, COLOR_SIDE)
    counts = [np.bincount(small[:, :, c].ravel(), minlength=256).reshape(COLOR_BINS, -1).sum(axis=1) for c in range(3)]
    return np.concatenate(counts) / (COLOR_SIDE * COLOR_SIDE)


def edge_vector(rgb: np.ndarray) -> np.ndarray:
    """Mean gradient magnitude of 8 cells along x by 4 along y, scaled so the largest is 1."""
    p = grey(resample(rgb, EDGE_SIDE, EDGE_SIDE)).T.astype(np.float64)
    across, along = p[2:] - p[:-2], p[:, 2:] - p[:, :-2]
    gx = across[:, :-2] + 2 * across[:, 1:-1] + across[:, 2:]
    gy = along[:-2] + 2 * along[1:-1] + along[2:]
    magnitude = np.pad(np.sqrt(gx * gx + gy * gy), 1)
    cells = magnitude.reshape(8, 8, 4, 16).mean(axis=(1, 3)).ravel()
    top = cells.max()
    return cells / top if top > 0 else cells


VECTOR = T.ArrayType(T.DoubleType())
PHASH = Processor("phash", T.StringType(), perceptual_hash, "0" * 16)
COLOR = Processor("color_vector", VECTOR, color_histogram, [0.0] * 48)
EDGE = Processor("edge_vector", VECTOR, edge_vector, [0.0] * 32)
DCT = Processor("dct", VECTOR, lambda rgb: dct_block(rgb).ravel(), [0.0] * 64)
DEFAULT_PROCESSORS = (PHASH, COLOR, EDGE)


def capped_size(width: Column, height: Column, edge: int) -> Column:
    """(width, height) after shrinking so that the longest edge is at most `edge`."""
    longest = F.greatest(width, height)

    def side(dim: Column) -> Column:
        return F.when(longest > edge, F.greatest(F.lit(1), F.round(dim * F.lit(float(edge)) / longest))).otherwise(dim)

    return F.struct(side(width).cast("int").alias("width"), side(height).cast("int").alias("height"))


def _pixels(width: int, height: int, channels: int, data: np.ndarray) -> np.ndarray | None:
    """RGB view of a BGR(A) or grey buffer; None when the buffer is too short."""
    if channels not in (1, 3, 4) or data.size < width * height * channels:
        return None
    grid = data[: width * height * channels].reshape(height, width, channels)
    return np.repeat(grid, 3, axis=2) if channels == 1 else grid[:, :, 2::-1]


def _fingerprint_udf(processors: Sequence[Processor]):
    merged = {p.name: p for p in processors}  # a later processor replaces an earlier one of the same name
    dtype = T.StructType([T.StructField(p.name, p.dtype) for p in merged.values()])

    @F.arrow_udf(dtype)
    def compute(width: pa.Array, height: pa.Array, channels: pa.Array, data: pa.Array, sizes: pa.Array) -> pa.Array:
        out: list[dict | None] = []
        for w, h, c, blob, targets in zip(
            width.to_pylist(), height.to_pylist(), channels.to_pylist(), data, sizes.to_pylist()
        ):
            if w is None or h is None or w <= 0 or h <= 0 or not blob.is_valid:
                out.append(None)
                continue
            rgb = _pixels(w, h, c, np.frombuffer(blob.as_buffer(), dtype=np.uint8))
            shrink = [t for t in targets if (t["width"], t["height"]) != (w, h)]
            if rgb is None:
                out.append(None if shrink else {n: p.blank for n, p in merged.items()})
                continue
            for t in targets:
                if rgb.shape[:2] != (t["height"], t["width"]):
                    rgb = resample(rgb, t["width"], t["height"])
            out.append({n: p.compute(rgb) for n, p in merged.items()})
        fields = []
        for name, p in merged.items():
            kind = pa.list_(pa.float64()) if p.dtype == VECTOR else None
            fields.append(pa.array([None if row is None else row[name] for row in out], type=kind))
        mask = pa.array([row is None for row in out], type=pa.bool_())
        return pa.StructArray.from_arrays(fields, names=list(merged), mask=mask)

    return compute


def fingerprint(
    images: DataFrame,
    processors: Sequence[Processor] = DEFAULT_PROCESSORS,
    working_edge: int = MAX_WORKING_EDGE,
    probe_edge: int | None = None,
) -> DataFrame:
    """Replace the pixel columns of `images` by a `fingerprint` struct, null for an undecodable image.

    Images are first shrunk to `probe_edge` where given (probe intake), then to `working_edge`.
    """
    size = F.struct(F.col("width"), F.col("height"))
    sizes = []
    for edge in (probe_edge, working_edge):
        if edge:
            size = capped_size(size["width"], size["height"], edge)
            sizes.append(size)
    compute = _fingerprint_udf(processors)
    return images.withColumn(
        "fingerprint", compute("width", "height", "n_channels", "data", F.array(*sizes))
    ).drop("n_channels", "data")


def with_features(images: DataFrame, processors: Sequence[Processor] = DEFAULT_PROCESSORS, **options) -> DataFrame:
    """`fingerprint` with the features as columns."""
    return fingerprint(images, processors, **options).select("*", "fingerprint.*").drop("fingerprint")
