"""64-bit image hashes: hex text to long, distance, and the perceptual hash itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernlake.functions.pictures import LANCZOS, gray, resized


def from_hex(text: Column) -> Column:
    """Sixteen hex digits as a signed long (base -10 reads them as two's complement)."""
    return F.conv(text, 16, -10).cast("bigint")


def to_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _dct_rows(n: int) -> np.ndarray:
    k, i = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    return 2 * np.cos(np.pi * k * (2 * i + 1) / (2 * n))


def phash(plane: np.ndarray, hash_size: int = 8, factor: int = 4) -> int:
    """Bits, row by row, of the low block of the cosine transform of an eight-bit picture in small: 1 above its median."""
    rows = _dct_rows(hash_size * factor)
    low = (rows @ resized(plane, hash_size * factor, hash_size * factor, LANCZOS).astype(float) @ rows.T)[:hash_size, :hash_size]
    return int("".join("1" if b else "0" for b in (low > np.median(low)).ravel()), 2)


def luma(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Gray values of decoded pixels in blue-green-red order."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return pixels[:, :, 0] if channels == 1 else gray(pixels[:, :, 2], pixels[:, :, 1], pixels[:, :, 0])


def hash_images(images: DataFrame, top: float = 0.06, bottom: float = 0.10, left: float = 0.0, right: float = 0.0) -> DataFrame:
    """``file_name, hash_hex`` of decoded images (``image`` struct of the image source), cropped first.

    Images that could not be decoded have a null hash. Narrow: one pass, no shuffle.
    """
    from fernlake.functions.boxes import check_crop
    from fernlake.functions.names import basename

    check_crop(top, bottom, left, right)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for data, h, w, c in zip(batch["data"], batch["height"], batch["width"], batch["channels"]):
                if data is None or h <= 0 or w <= 0:
                    out.append(None)
                    continue
                shown = luma(data, h, w, c)[round(h * top) : round(h * (1 - bottom)), round(w * left) : round(w * (1 - right))]
                out.append(f"{phash(shown):016x}" if shown.size else None)
            yield pd.DataFrame({"file_name": batch["file_name"], "hash_hex": out})

    own = images.select(basename(F.col("image.origin")).alias("file_name"), F.col("image.data").alias("data"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"))
    return own.mapInPandas(run, "file_name string, hash_hex string")
