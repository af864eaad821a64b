"""Bursts on an unbounded stream of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pickline.operators.groups import burst_chains, split_groups
from pickline.operators.skew import attach
from pickline.session import cut

FRAME = "id string, taken_at timestamp, camera string, dhash bigint"
GROUP = "id string, head string, slice bigint, pos bigint"


def _groups(chains: DataFrame, max_group: int) -> DataFrame:
    return split_groups(chains, max_group, "head").select("id", "head", "slice", "pos")


def stream_bursts(
    frames: DataFrame,
    path: str,
    gap_seconds: float = 10.0,
    max_distance: int | None = 26,
    max_group: int = 10,
    lateness_seconds: float = 0.0,
    once: bool = True,
) -> StreamingQuery:
    """Emit a chain's groups to ``path/groups`` once no frame can join it any more.

    The state is a table: the frames of chains that are still open, one version per micro-batch
    under ``path/open``. A micro-batch chains these and the new frames with the batch operator,
    so a camera with a third of all frames is spread over tasks here too. The watermark is the
    greatest time seen so far less ``lateness_seconds``; a chain is closed when the watermark has
    passed its last frame by more than the gap. Frames older than the watermark of earlier
    batches are dropped, where grouping the whole table again would place them. A repeated
    micro-batch writes the same versions again.
    """
    spark = frames.sparkSession

    def state(batch: int) -> tuple[DataFrame, DataFrame]:
        if batch < 0:
            return spark.createDataFrame([], FRAME), spark.createDataFrame([], "mark timestamp")
        return (spark.read.schema(FRAME).parquet(f"{path}/open/{batch}"),
                spark.read.schema("mark timestamp").parquet(f"{path}/mark/{batch}"))

    def step(rows: DataFrame, batch: int) -> None:
        open_, marks = state(batch - 1)
        mark = marks.agg(F.max("mark")).first()[0]
        fresh = rows.select("id", "taken_at", "camera", "dhash").filter("taken_at is not null")
        if mark is not None:
            fresh = fresh.filter(F.col("taken_at") >= F.lit(mark))
        frames_now = cut(fresh.unionByName(open_).dropDuplicates(["id"]))
        late = F.expr(f"interval {int(lateness_seconds * 1e6)} microseconds")
        newest = frames_now.agg((F.max("taken_at") - late).alias("m")).first()["m"]
        seen = [m for m in (mark, newest) if m is not None]
        spark.createDataFrame([(max(seen),)] if seen else [], "mark timestamp").write.mode(
            "overwrite").parquet(f"{path}/mark/{batch}")
        chains = cut(burst_chains(frames_now, gap_seconds, max_distance))
        # frames of a chain are in order of time, so its last row has its end and its length
        since = F.unix_micros(F.lit(max(seen) if seen else None).cast("timestamp")) \
            - F.unix_micros("taken_at")
        closed = F.coalesce(since > int(round(gap_seconds * 1e6)), F.lit(False))
        still = chains.filter("last").filter(~closed).select("segment", (F.col("pos") + 1).alias("n"))
        marked = attach(chains, still, "segment", "n", keep=True)
        _groups(marked.filter("n is null"), max_group).write.mode("overwrite").parquet(
            f"{path}/groups/{batch}")
        marked.filter("n is not null").select("id", "taken_at", "camera", "dhash").write.mode(
            "overwrite").parquet(f"{path}/open/{batch}")

    writer = frames.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/_stream")
    return (writer.trigger(availableNow=True) if once else writer).start()


def emitted_groups(spark: SparkSession, path: str) -> DataFrame:
    """Groups emitted so far."""
    return spark.read.schema(GROUP).option("recursiveFileLookup", "true").parquet(f"{path}/groups")


def open_groups(
    spark: SparkSession, path: str, batch: int, gap_seconds: float = 10.0,
    max_distance: int | None = 26, max_group: int = 10,
) -> DataFrame:
    """Groups of the chains still open after a micro-batch, as if the stream ended there."""
    frames = spark.read.schema(FRAME).parquet(f"{path}/open/{batch}")
    return _groups(cut(burst_chains(frames, gap_seconds, max_distance)), max_group)
