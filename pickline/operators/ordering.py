"""Positions, runs and sequential scans over a global order, without a one-task window.

``Window.orderBy`` with no partition sends every row to one task, and a window per camera or per
component sends a hot key to one task. Everything here sorts by range instead: the sort key ends
in a unique id, so range bounds can fall inside a hot key and the partitions stay even. What must
cross a partition border is one summary row per partition.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from pickline.session import cut

PART, ROW = "_part", "_row"
_LOCAL_BITS = 33  # monotonically_increasing_id: partition above, row within partition below
#: Rows per block of a sequential scan.
BLOCK_ROWS = 65_536
#: Rows that one task sorts at the end of a selection, and pivots of a pass.
TASK_ROWS, PIVOTS = 100_000, 32


def globally_ordered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, with partition and row numbers.

    Range bounds are sampled per run, so the numbered rows are written once and every reader sees
    the same borders, also after an executor is lost.
    """
    numbered = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn(PART, F.shiftright("_id", _LOCAL_BITS))
        .withColumn(ROW, F.col("_id").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
        .drop("_id")
    )
    return cut(numbered)


def with_position(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Add the 0-based position of every row in the global order."""
    rows = globally_ordered(df, *order)
    # one row per range partition: the window and the broadcast are bounded by their number
    offsets = rows.groupBy(PART).agg((F.max(ROW) + 1).alias("_n")).select(
        PART,
        (F.sum("_n").over(Window.orderBy(PART)) - F.col("_n")).alias("_offset"),
    )
    return (
        rows.join(F.broadcast(offsets), PART)
        .withColumn(name, F.col("_offset") + F.col(ROW))
        .drop(PART, ROW, "_offset")
    )


def _before(df: DataFrame, pivot: Row, keys: list[tuple[str, bool]], equal: bool) -> Column:
    """Whether a row sorts before ``pivot`` (or like it); nulls are the least values."""
    kinds = dict(df.dtypes)
    found = F.lit(equal)
    for name, ascending in reversed(keys):
        here, there = F.col(f"`{name}`"), F.lit(pivot[name]).cast(kinds[name])
        if pivot[name] is None:
            less, more = F.lit(False), here.isNotNull()
        else:
            less, more = here.isNull() | (here < there), here > there
        first = F.coalesce(less if ascending else more, F.lit(False))
        found = first | (here.eqNullSafe(there) & found)
    return found


def top_n(df: DataFrame, n: int, *keys: tuple[str, bool], task_rows: int = TASK_ROWS) -> DataFrame:
    """The first ``n`` rows in order of ``keys``, pairs of a column and whether it ascends.

    Nulls are the least values. By distributed selection: rows are counted between a few sampled
    pivots, and again within the stretch that holds the ``n``-th row, until that has at most
    ``task_rows`` rows. Counting moves a number per task and stretch; only the rows up to the end of
    the last stretch are sorted, so the table itself is never shuffled, whatever ``n`` is.
    """
    rows = cut(df)
    low, high = None, None
    before, inside = 0, rows.count()
    selects = 0 < n < inside  # else there is nothing to select
    while selects and inside > task_rows:
        within = rows
        if low is not None:
            within = within.filter(~_before(rows, low, keys, True))
        if high is not None:
            within = within.filter(_before(rows, high, keys, True))
        names = [name for name, _ in keys]
        drawn = within.select(*names).sample(min(1.0, 8 * PIVOTS / inside), seed=inside)
        ordered = drawn.orderBy(*_sorted_by(keys)).collect()
        pivots = ordered[:: max(1, len(ordered) // PIVOTS)]
        if not pivots:
            pivots = [within.select(*names).first()]
        stretch = sum((F.when(_before(rows, p, keys, True), 0).otherwise(1) for p in pivots), F.lit(0))
        counts = dict(within.groupBy(stretch.alias("s")).count().collect())
        for k in range(len(pivots) + 1):
            if before + counts.get(k, 0) >= n:
                break
            before += counts.get(k, 0)
        if k:
            low = pivots[k - 1]
        if k < len(pivots):
            high = pivots[k]
        if counts.get(k, 0) == inside:  # rows with one key, which no pivot can part
            break
        inside = counts.get(k, 0)
    if n <= 0:
        return rows.limit(0)
    some = rows if high is None else rows.filter(_before(rows, high, keys, True))
    order = _sorted_by(keys)
    if n <= task_rows:
        return some.orderBy(*order).limit(n)
    placed = with_position(some, *order, name="_position")
    return placed.filter(F.col("_position") < n).orderBy("_position").drop("_position")


def _sorted_by(keys) -> list[Column]:
    return [F.col(f"`{name}`").asc_nulls_first() if ascending else F.col(f"`{name}`").desc_nulls_last()
            for name, ascending in keys]


def _with_previous(batches):
    """Each row's ``_this`` next to that of the row before it in the partition."""
    import pyarrow as pa

    before = None
    for batch in batches:
        if not len(batch):
            continue
        this = batch["_this"]
        first = before is None
        shifted = pa.concat_arrays([pa.nulls(1, this.type) if first else before, this.slice(0, len(this) - 1)])
        before = this.slice(len(this) - 1, 1)
        opens = np.zeros(len(this), bool)
        opens[0] = first
        yield pa.RecordBatch.from_arrays([*batch.columns, shifted, pa.array(opens)],
                                         [*batch.schema.names, "_prev", "_opens"])


def _numbered(batches):
    """Runs of a sorted partition: ``_seg`` starts so far, ``_pos`` in the run, the run's ``_head``.

    The partition's first row opens run 0, whether it goes on with a run of the partition before or
    not. ``_last`` is null for the partition's last row.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    part, row, runs, begin, head, pending = TaskContext.get().partitionId(), 0, 0, 0, None, None

    def ended(batch, last):
        return pa.RecordBatch.from_arrays([*batch.columns, last], [*batch.schema.names, "_last"])

    for batch in batches:
        n = len(batch)
        if not n:
            continue
        start = batch["_start"].to_numpy(zero_copy_only=False)
        at = row + np.arange(n)
        first_of_run = np.maximum.accumulate(np.where(start, at, begin))
        heads = pa.concat_arrays([batch["_head"].slice(0, 1) if head is None else head, batch["_head"]])
        from_here = np.maximum.accumulate(np.where(start, np.arange(1, n + 1), 0))
        own = pc.take(heads, pa.array(from_here))
        seg = runs + np.cumsum(start)
        out = pa.RecordBatch.from_arrays(
            [batch["_this"], own, pa.array(np.full(n, part, np.int32)), pa.array(at),
             pa.array(seg.astype(np.int64)), pa.array(at - first_of_run)],
            ["_this", "_head", PART, ROW, "_seg", "_pos"])
        if pending is not None:
            yield ended(pending, pa.array([bool(start[0])]))
        if n > 1:
            yield ended(out.slice(0, n - 1), pa.array(start[1:]))
        pending, head = out.slice(n - 1, 1), own.slice(n - 1, 1)
        row, runs, begin = row + n, int(seg[-1]), int(first_of_run[-1])
    if pending is not None:
        yield ended(pending, pa.nulls(1, pa.bool_()))


def segments(
    df: DataFrame,
    order: list[Column],
    linked: Callable[[Column, Column], Column],
    head: Column,
) -> DataFrame:
    """Cut the global order into runs of rows that link to their predecessor.

    ``linked(previous, current)`` takes two struct columns holding all columns of ``df``. Adds
    ``segment`` (0-based number in order), ``pos`` (0-based within the segment), ``last`` (whether
    the row ends its segment) and ``head`` (the expression's value on the segment's first row).

    Rows are shuffled once, by range. Two streaming passes over the sorted partition number its runs,
    and one summary row per partition (its first and last row, its runs and the length of the last
    one) tells how they go on across borders.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    packed = (
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .select(F.struct(*columns).alias("_this"), F.struct(head.alias("v")).alias("_head"))
    )
    this, first = packed.schema["_this"], packed.schema["_head"]
    beside = StructType([this, first, StructField("_prev", this.dataType), StructField("_opens", BooleanType())])
    numbered = StructType([
        this, first, StructField(PART, IntegerType()), StructField(ROW, LongType()),
        StructField("_seg", LongType()), StructField("_pos", LongType()), StructField("_last", BooleanType())])
    link = F.coalesce(linked(F.col("_prev"), F.col("_this")), F.lit(False))
    rows = cut(
        packed.mapInArrow(_with_previous, beside)
        .select("_this", "_head", (~F.col("_opens") & ~link).alias("_start"))
        .mapInArrow(_numbered, numbered)
    )
    parts = Window.orderBy(PART)  # over one row per partition only
    upto = parts.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    summary = rows.groupBy(PART).agg(
        F.count("*").alias("_n"), F.max("_seg").alias("_starts"),
        F.min_by("_this", ROW).alias("_this"), F.max_by("_this", ROW).alias("_tail"),
        F.min_by("_head", ROW).alias("_first_head"), F.max_by("_head", ROW).alias("_last_head"),
        (F.max_by("_pos", ROW) + 1).alias("_length"),
    ).withColumn("_prev", F.lag("_tail").over(parts)).withColumn(
        "_goes_on", F.col("_prev").isNotNull() & link).withColumn(
        "_offset", F.sum("_n").over(parts) - F.col("_n"))
    new_run = ~F.col("_goes_on") | (F.col("_starts") > 0)
    ends = summary.select(
        PART, "_goes_on", "_offset",
        (F.coalesce(F.sum("_starts").over(before), F.lit(0))
         + F.sum(F.when(F.col("_goes_on"), 0).otherwise(1)).over(upto) - 1).alias("_base"),
        # where the partition's last run began, and its head: its own or that of a partition before
        F.when(F.col("_starts") > 0, F.col("_offset") + F.col("_n") - F.col("_length"))
        .when(~F.col("_goes_on"), F.col("_offset")).alias("_begin"),
        F.when(F.col("_starts") > 0, F.struct(F.col("_last_head")["v"].alias("v")))
        .when(new_run, F.struct(F.col("_first_head")["v"].alias("v"))).alias("_run_head"),
    )
    carried = ends.select(
        F.col(PART).alias("_in"), "_goes_on", "_base",
        (F.col("_offset") - F.last("_begin", ignorenulls=True).over(before)).alias("_open_pos"),
        F.last("_run_head", ignorenulls=True).over(before).alias("_open_head"),
        (~F.lead("_goes_on").over(parts)).alias("_ends"),
    )
    open_run = (F.col("_seg") == 0) & F.col("_goes_on")
    return rows.join(F.broadcast(carried), F.col(PART) == F.col("_in")).select(
        *[F.col("_this")[c].alias(c) for c in df.columns],
        (F.col("_base") + F.col("_seg")).alias("segment"),
        F.when(open_run, F.col("_pos") + F.col("_open_pos")).otherwise(F.col("_pos")).alias("pos"),
        F.coalesce("_last", "_ends", F.lit(True)).alias("last"),
        F.when(open_run, F.col("_open_head")).otherwise(F.col("_head"))["v"].alias("head"),
    )


def carried_scan(
    rows: DataFrame,
    scan: Callable[[pd.DataFrame, pd.DataFrame], tuple[pd.DataFrame, pd.DataFrame]],
    row_ddl: str,
    carry_ddl: str,
    onward: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Run a sequential scan block by block in parallel and repeat until the carries agree.

    ``rows`` has a contiguous 0-based ``block`` column. ``scan(block_rows, carry_in)`` returns the
    block's result rows and what it hands to the next block. All blocks first run with an empty
    carry; then only blocks whose incoming carry changed run again. When nothing changes, every
    block has seen its true predecessor, so the result is the sequential one. Each pass settles
    at least one more block, and scans that forget their start settle in two or three.

    ``onward`` maps what blocks hand on, ``(block, c)``, to the blocks it goes to; the next one if not
    given. It can lead a carry past blocks that are known to leave it as it is.
    """
    onward = onward or (lambda handed: handed.withColumn("block", F.col("block") + 1))
    spark = rows.sparkSession
    result_fields = f"block bigint, is_carry boolean, r struct<{row_ddl}>, c struct<{carry_ddl}>"
    row_names = [p.split()[0] for p in row_ddl.replace(":", " ").split(",")]
    carry_names = [p.split()[0] for p in carry_ddl.replace(":", " ").split(",")]

    def run(key, block, carry):
        if block.empty:  # a carry past the last block
            return pd.DataFrame({c: pd.Series(dtype=object) for c in ("block", "is_carry", "r", "c")})
        done, out = scan(block, carry)
        rows, handed = (
            frame[names].to_dict("records")
            for frame, names in ((done, row_names), (out, carry_names))
        )
        return pd.DataFrame({
            "block": key[0],
            "is_carry": [False] * len(rows) + [True] * len(handed),
            "r": pd.Series(rows + [None] * len(handed), dtype=object),
            "c": pd.Series([None] * len(rows) + handed, dtype=object),
        })

    carry_type = f"block bigint, c struct<{carry_ddl}>"
    carry = spark.createDataFrame([], carry_type)
    todo, kept = rows, None
    while True:
        flat = carry.select("block", "c.*")
        fresh = todo.groupBy("block").cogroup(flat.groupBy("block")).applyInPandas(
            run, result_fields
        )
        kept = cut(fresh if kept is None else kept.unionByName(fresh))
        handed = onward(kept.filter("is_carry").select("block", "c"))
        both = handed.withColumn("new", F.lit(1)).unionByName(carry.withColumn("new", F.lit(-1)))
        # whether the carry of a block changed: at most one row per block
        changed = cut(
            both.groupBy("block", "c").agg(F.sum("new").alias("d")).filter("d <> 0")
            .select("block").distinct()
            .join(rows.select("block").distinct(), "block", "left_semi")
        )
        if changed.isEmpty():
            return kept.filter("not is_carry").select("block", "r.*")
        carry = cut(handed)
        todo = rows.join(F.broadcast(changed), "block", "left_semi")
        kept = kept.join(F.broadcast(changed), "block", "left_anti")
