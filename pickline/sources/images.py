"""Perceptual hashes of image files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pickline.functions.scalars import dhash_bits


def _box_mean(grey: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Shrink to ``rows x cols`` by the mean of each covered area, borders weighted by overlap."""
    def weights(size: int, cells: int) -> np.ndarray:
        edges = np.linspace(0, size, cells + 1)
        lo = np.maximum(edges[:-1, None], np.arange(size)[None, :])
        hi = np.minimum(edges[1:, None], np.arange(size)[None, :] + 1)
        w = np.clip(hi - lo, 0, None)
        return w / w.sum(axis=1, keepdims=True)

    return weights(grey.shape[0], rows) @ grey @ weights(grey.shape[1], cols).T


def grey_grid(hash_size: int):
    """A pandas UDF from Spark image structs to row-major grey grids, null for unreadable ones."""

    @F.pandas_udf("array<double>")
    def grid(images: pd.DataFrame) -> pd.Series:
        out = []
        for image in images.itertuples(index=False):
            if image.height <= 0 or image.data is None:
                out.append(None)
                continue
            pixels = np.frombuffer(image.data, dtype=np.uint8).reshape(
                image.height, image.width, image.nChannels
            ).astype(float)
            if image.nChannels >= 3:  # stored blue, green, red; fixed luma weights
                grey = pixels[..., :3] @ np.array([0.114, 0.587, 0.299])
            else:
                grey = pixels[..., 0]
            out.append(np.rint(_box_mean(grey, hash_size, hash_size + 1)).ravel())
        return pd.Series(out)

    return grid


def hash_images(spark: SparkSession, path: str, hash_size: int = 8) -> DataFrame:
    """``(path, dhash)`` for every image under ``path``; unreadable files get a null hash."""
    images = (
        spark.read.format("image").option("dropInvalid", "false")
        .option("recursiveFileLookup", "true").load(path)
    )
    grids = images.select(
        F.col("image.origin").alias("path"), grey_grid(hash_size)(F.col("image")).alias("grid")
    )
    return grids.select("path", dhash_bits(F.col("grid"), hash_size).alias("dhash"))
