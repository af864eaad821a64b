"""Packing work items into batches below a count and a size cap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Caps of one submission.
MAX_COUNT = 5_000
MAX_BYTES = 180 * 1024 * 1024
#: Full batches that one task fills; at most one more per task stays part full.
BATCHES_PER_TASK = 8
#: Small parts share a task up to so many items and bytes.
ITEMS_PER_TASK, BYTES_PER_TASK = 100_000, BATCHES_PER_TASK * MAX_BYTES


def pack_batches(
    items: DataFrame,
    max_count: int = MAX_COUNT,
    max_bytes: int = MAX_BYTES,
    key: str = "custom_id",
    size: str = "bytes",
    partitions: int | None = None,
) -> DataFrame:
    """Add ``batch_id``: partitions are filled in parallel, items in key order.

    No batch exceeds a cap unless a single item does. The number of partitions follows from the
    counted items and bytes, unless given. Items are spread by key, so a partition holds the same
    items in the same order when it is computed again, and ids stay the same. With small caps there
    are very many partitions, so a task fills as many, one after the other, as make up its share.
    """
    n = partitions
    total = items.agg(F.count("*").alias("n"), F.sum(size).alias("b")).first()
    if n is None:
        full = max(total.n / max_count, (total.b or 0) / max_bytes)
        n = max(1, math.ceil(full / BATCHES_PER_TASK))
    tasks = max(1, math.ceil(total.n / ITEMS_PER_TASK), math.ceil((total.b or 0) / BYTES_PER_TASK))
    spread = items.withColumn("_part", F.pmod(F.hash(key), F.lit(n))).repartition(
        min(n, tasks), "_part").sortWithinPartitions("_part", key)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, count, total, part = 0, 0, 0, None
        for frame in frames:
            all_sizes = frame[size].to_numpy(np.int64)
            all_numbers = np.empty(len(all_sizes), np.int64)
            parts = frame.pop("_part").to_numpy()
            borders = np.flatnonzero(np.diff(parts)) + 1
            for low, high in zip([0, *borders], [*borders, len(parts)], strict=True):
                if low < high and parts[low] != part:
                    seq, count, total, part = 0, 0, 0, parts[low]
                sizes, numbers = all_sizes[low:high], all_numbers[low:high]
                ends = np.cumsum(sizes)
                at = 0
                while at < len(sizes):
                    passed = ends[at - 1] if at else 0
                    fit = int(np.searchsorted(ends, passed + max_bytes - total, side="right")) - at
                    fit = min(fit, max_count - count, len(sizes) - at)
                    if fit <= 0 and count:  # the next item would breach a cap
                        seq, count, total = seq + 1, 0, 0
                        continue
                    fit = max(fit, 1)
                    numbers[at:at + fit] = seq
                    count, total = count + fit, total + int(ends[at + fit - 1] - passed)
                    at += fit
            names = pd.Series(parts, index=frame.index).astype(str)
            frame["batch_id"] = "p" + names + "." + pd.Series(all_numbers, index=frame.index).astype(str)
            yield frame

    return spread.mapInPandas(fill, f"{fields}, batch_id string")
