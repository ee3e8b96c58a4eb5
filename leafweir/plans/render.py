"""Rendering by engines outside Spark: crops, file names, option checks, pixel statistics.

An engine is any function (path, page, scale, crop) to RGBA bytes; ``rendered`` maps it over pages in
Arrow batches, so one engine lives in each Python worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values
LEAST_OCR_SCALE, MOST_SCALE, ALPHA, BUCKET = 2.0, 4.0, 16, 16


def scale_of(scale: float | None) -> float:
    if scale is None:
        return 2.0
    if not 0 < scale <= MOST_SCALE:
        raise ValueError("scale must be within 0 and 4")
    return round(scale, 2)


def ocr_scale(scale: float | None) -> float:
    return max(scale_of(scale), LEAST_OCR_SCALE)


def ocr_languages(said: str) -> list[str]:
    """``eng+jpn`` as a list; each once, letters and underscores only."""
    parts = said.split("+")
    if not all(re.fullmatch(r"[A-Za-z_]+", p) for p in parts):
        raise ValueError(f"not a language list: {said!r}")
    return list(dict.fromkeys(parts))


def region_of(region: tuple[float, float, float, float] | None, page_width: float, page_height: float) -> tuple[float, float, float, float] | None:
    """x, y, width, height within the page, or an error."""
    if region is None:
        return None
    x, y, w, h = region
    if w <= 0 or h <= 0 or x < -0.01 or y < -0.01 or x + w > page_width + 0.01 or y + h > page_height + 0.01:
        raise ValueError("the region lies outside the page")
    return region


def crop_pixels(region: tuple[float, float, float, float], scale: float, rotation: int, page_width: float, page_height: float) -> tuple[int, int, int, int]:
    """A page box as left, top, width, height in the pixels of a page shown turned by 0, 90, 180 or 270 degrees."""
    x, y, w, h = region
    x, y, w, h = {0: (x, y, w, h), 90: (page_height - y - h, x, h, w), 180: (page_width - x - w, page_height - y - h, w, h), 270: (y, page_width - x - w, h, w)}[rotation % 360]
    left, top = int(np.floor(x * scale)), int(np.floor(y * scale))
    return left, top, max(1, int(np.ceil((x + w) * scale)) - left), max(1, int(np.ceil((y + h) * scale)) - top)


def png_name(page: int, region: tuple[float, float, float, float] | None = None) -> str:
    return f"page-{page:04d}" + ("" if region is None else "-" + "x".join(f"{v:g}" for v in region)) + ".png"


def unique_paths(rows: DataFrame, name: str = "name") -> DataFrame:
    """Names of files in one folder, repeated ones told apart by ``-2``, ``-3``."""
    k = F.row_number().over(Window.partitionBy(name).orderBy("doc_id", "page"))
    return rows.withColumn("_k", k).withColumn("path", F.when(F.col("_k") == 1, F.col(name)).otherwise(F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("-"), "_k", F.regexp_extract(name, r"(\.[^.]*)$", 1)))).drop("_k")


def content_stats(rgba: bytes, width: int) -> tuple[float, tuple[int, int, int, int] | None]:
    """Share of pixels that differ from the commonest brightness, and the box around them."""
    px = np.frombuffer(rgba, dtype=np.uint8).reshape(-1, width, 4).astype(np.float64)
    alpha = px[..., 3:] / 255
    light = ((px[..., :3] * alpha + 255 * (1 - alpha)) @ np.array([0.2126, 0.7152, 0.0722])).round().astype(np.int64)
    paper = np.bincount((light // BUCKET).ravel(), minlength=256 // BUCKET + 1).argmax() * BUCKET + BUCKET // 2
    ink = (np.abs(light - paper) > 2 * BUCKET) & (px[..., 3] >= ALPHA)
    if not ink.any():
        return 0.0, None
    ys, xs = np.flatnonzero(ink.any(axis=1)), np.flatnonzero(ink.any(axis=0))
    return round(float(ink.mean()), 6), (int(xs[0]), int(ys[0]), int(xs[-1] - xs[0] + 1), int(ys[-1] - ys[0] + 1))


def content_box(pixels: tuple[int, int, int, int], scale: float, crop: tuple[int, int] = (0, 0)) -> tuple[float, float, float, float]:
    """Pixel bounds as a page box."""
    x, y, w, h = pixels
    return tuple(float(np.floor(v / scale * 100 + 0.5) / 100) for v in (x + crop[0], y + crop[1], w, h))


def with_content(images: DataFrame) -> DataFrame:
    """doc_id, page, rgba, pixel_width with render_content_ratio and content bounds, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [content_stats(r, w) for r, w in zip(batch.column("rgba").to_pylist(), batch.column("pixel_width").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("page"), pa.array([g[0] for g in got], type=pa.float64()), pa.array([None if g[1] is None else list(g[1]) for g in got], type=pa.list_(pa.int32()))], names=["doc_id", "page", "render_content_ratio", "bounds"])

    return images.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), "rgba", "pixel_width").mapInArrow(run, "doc_id long, page int, render_content_ratio double, bounds array<int>")


def rendered(pages: DataFrame, engine: Callable[[str, int, float], tuple[bytes, int]], scale: float = 2.0) -> DataFrame:
    """doc_id, page, rgba, pixel_width of pages (doc_id, path, page) by an engine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [engine(p, n, scale) for p, n in zip(batch.column("path").to_pylist(), batch.column("page").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("page"), pa.array([g[0] for g in got], type=pa.binary()), pa.array([g[1] for g in got], type=pa.int32())], names=["doc_id", "page", "rgba", "pixel_width"])

    return pages.select(F.col("doc_id").cast("long").alias("doc_id"), "path", F.col("page").cast("int").alias("page")).mapInArrow(run, "doc_id long, page int, rgba binary, pixel_width int")
