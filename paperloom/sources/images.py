"""Crops: statistics for the geometry rules, cutting and stacking, on Spark's image source."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import normalised_to_pixels, points_to_pixels, rect

# Fixed values of the crop rules: dark below, band height, least height, least dark share, ratio.
DARK, BAND, MIN_HEIGHT, MIN_DARK, RATIO = 200, 2, 20, 0.02, 2.5
#: Points around a rectangle that its crop shows too.
PAD_POINTS = 3.0


def grey(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Luma of BGR bytes with the ITU-R 601 weights, in 16-bit fixed point."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return a[:, :, 0]
    b, g, r = (a[:, :, i].astype(np.uint32) for i in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def statistics(pixels: np.ndarray) -> tuple[float, bool]:
    """Standard deviation, and whether ink at the top or bottom edge looks cut off."""
    if not pixels.size:
        return 0.0, False
    dark = pixels < DARK
    share = float(dark.mean())
    if len(pixels) < MIN_HEIGHT or share < MIN_DARK:
        return float(pixels.std()), False
    return float(pixels.std()), bool(max(dark[:BAND].mean(), dark[-BAND:].mean()) / share > RATIO)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("image").option("recursiveFileLookup", "true").load(path).select("image.*")


def crop_statistics(images: DataFrame, root: str) -> DataFrame:
    """path (below ``root``), width, height, stddev, clipped of each image."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [statistics(grey(bytes(d), h, w, c)) for d, h, w, c in zip(f["data"], f["height"], f["width"], f["nChannels"], strict=True)]
            yield pd.DataFrame({"origin": f["origin"], "width": f["width"], "height": f["height"], "stddev": [s for s, _ in found], "clipped": [c for _, c in found]})

    base = F.lit(root.rstrip("/").removeprefix("file://") + "/")
    rows = images.select("origin", "width", "height", "nChannels", "data").mapInPandas(run, "origin string, width int, height int, stddev double, clipped boolean")
    return rows.select(F.element_at(F.split("origin", base, 2), -1).alias("path"), "width", "height", "stddev", "clipped")


def cut(pixels: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """The part of an image that a normalised box covers, edges cut down to whole pixels."""
    h, w = pixels.shape[:2]
    x0, y0, x1, y1 = box
    return pixels[int(y0 * h) : int(y1 * h), int(x0 * w) : int(x1 * w)]


def stack(parts: list[np.ndarray]) -> np.ndarray:
    """Parts below each other, narrower ones scaled to the widest by nearest pixels."""
    width = max(p.shape[1] for p in parts)
    out = []
    for p in parts:
        if p.shape[1] != width:
            height = max(1, int(p.shape[0] * width / p.shape[1]))
            p = p[np.arange(height) * p.shape[0] // height][:, np.arange(width) * p.shape[1] // width]
        out.append(p)
    return np.concatenate(out)


def png(pixels: np.ndarray) -> bytes:
    """A grey or RGB image as PNG."""
    h, w = pixels.shape[:2]
    kind = 0 if pixels.ndim == 2 else 2

    def part(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(pixels, dtype=np.uint8))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def _crops(f: pd.DataFrame) -> Iterator[tuple[str, np.ndarray]]:
    """Path and pixels (grey or RGB) of each row's pixel box."""
    for r in f.to_dict("records"):
        a = np.frombuffer(bytes(r["data"]), np.uint8).reshape(r["height"], r["width"], r["nChannels"])
        a = a[:, :, 0] if r["nChannels"] == 1 else a[:, :, 2::-1]
        yield r["crop_path"], a[max(0, int(r["y0"])) : int(r["y1"]), max(0, int(r["x0"])) : int(r["x1"])]


def _with_pixels(images: DataFrame, regions: DataFrame, on: list[str], pixels: Column) -> DataFrame:
    return regions.join(images, on).select("crop_path", pixels.alias("px"), "data", "height", "width", "nChannels").select("crop_path", "px.*", "data", "height", "width", "nChannels")


def region_crops(images: DataFrame, regions: DataFrame) -> DataFrame:
    """regions (origin, crop_path, box: normalised) -> crop_path, content: PNG bytes cut from page images, to whole pixels."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(path, png(a)) for path, a in _crops(f)], columns=["crop_path", "content"])

    box = normalised_to_pixels(F.col("box"), F.col("width"), F.col("height"))
    return _with_pixels(images, regions, ["origin"], box).mapInPandas(run, "crop_path string, content binary")


def page_crops(images: DataFrame, rects: DataFrame, dpi: float, pad: float = PAD_POINTS) -> DataFrame:
    """rects (document_id, page_number, crop_path, box in points) -> crop_path, content, from pages rendered at ``dpi``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(path, png(a)) for path, a in _crops(f)], columns=["crop_path", "content"])

    return _with_pixels(images, rects, ["document_id", "page_number"], crop_plan(F.col("box"), dpi, pad)).mapInPandas(run, "crop_path string, content binary")


def crop_plan(box: Column, dpi: float, pad: float = PAD_POINTS) -> Column:
    """A rectangle in points, widened by ``pad`` on each side, as pixels of a page rendered at ``dpi``."""
    p = F.lit(float(pad))
    return points_to_pixels(rect(F.greatest(box["x0"] - p, F.lit(0.0)), F.greatest(box["y0"] - p, F.lit(0.0)), box["x1"] + p, box["y1"] + p), dpi)


def region_statistics(images: DataFrame, regions: DataFrame) -> DataFrame:
    """regions (document_id, page_number, path, box: normalised) -> path, width, height, stddev, clipped, without writing crops."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, a in _crops(f):
                plain = a if a.ndim == 2 else grey(np.ascontiguousarray(a[:, :, ::-1]).tobytes(), *a.shape)
                rows.append((path, a.shape[1], a.shape[0], *statistics(plain)))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "stddev", "clipped"])

    box = normalised_to_pixels(F.col("box"), F.col("width"), F.col("height"))
    rows = _with_pixels(images, regions.withColumnRenamed("path", "crop_path"), ["document_id", "page_number"], box)
    return rows.mapInPandas(run, "path string, width int, height int, stddev double, clipped boolean").dropDuplicates(["path"])


def stitched(parts: DataFrame) -> DataFrame:
    """parts (crop_path, part, height, width, nChannels, data) -> crop_path, content: a crop's parts below each other, as PNG.

    A crop has a few parts, one for each page it goes over.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("part").assign(x0=0, y0=0, x1=f["width"], y1=f["height"])
        cut_out = [a if a.ndim == 3 else np.repeat(a[:, :, None], 3, 2) for _, a in _crops(f)]
        return pd.DataFrame([(f["crop_path"].iloc[0], png(stack(cut_out)))], columns=["crop_path", "content"])

    return parts.groupBy("crop_path").applyInPandas(run, "crop_path string, content binary")
