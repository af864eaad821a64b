"""The repeating cycle as a stream: new assets and finished results, merged as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pickline.functions.scalars import interval_literal
from pickline.operators.judging import ingest_results
from pickline.operators.merges import merge_upsert
from pickline.schemas import ASSETS, empty_tables
from pickline.sources.tables import committed, load_tables, save_tables, table_paths, versions

Cycle = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]


def version(path: str, batch: int) -> str:
    """Where the tables stand after a micro-batch."""
    return f"{path}/tables/{batch}"


def _start(
    stream: DataFrame, path: str, step: Callable[[DataFrame, int], None], every: str, once: bool
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/_stream")
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{interval_literal(every)} seconds").start()


def _advance(
    spark: SparkSession, path: str, batch: int, start: str | None,
    change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]],
) -> None:
    """Write the version of a micro-batch; tables that ``change`` hands back as they are stay put.

    A micro-batch that runs again after its version was committed changes nothing.
    """
    if committed(spark, version(path, batch)):
        return
    done = [n for n in versions(spark, f"{path}/tables") if n < batch]
    origin = version(path, done[-1]) if done else start
    before = load_tables(spark, origin) if origin else empty_tables(spark)
    places = table_paths(spark, origin) if origin else {}
    after = change(dict(before))
    kept = {n: places[n] for n, df in after.items() if n in places and df is before[n]}
    save_tables(after, version(path, batch), "overwrite", kept)


def watch(
    assets: DataFrame,
    path: str,
    cycle: Cycle | None = None,
    every: str = "6h",
    once: bool = False,
    start: str | None = None,
) -> StreamingQuery:
    """Merge arriving ``assets`` rows and run ``cycle`` on the tables after each micro-batch.

    Only columns of the stream overwrite those of known assets, and the newest row per id wins.
    ``cycle`` maps the tables to their next state, for example a judging run over the work lists;
    verdicts on record stay, so only new work goes on. Every micro-batch writes a new version
    below ``path/tables`` with the tables that changed, starting from the tables under ``start``.
    """
    spark = assets.sparkSession

    def change(tables: dict[str, DataFrame], rows: DataFrame) -> dict[str, DataFrame]:
        known = [c for c in ASSETS.names if c in rows.columns]
        seq = F.struct(*[F.col(c) for c in ("scanned_at", *known) if c in known and c != "id"])
        tables["assets"] = merge_upsert(
            tables["assets"], rows.select(*known).withColumn("_seq", seq), "id", "_seq"
        )
        return cycle(tables) if cycle else tables

    def step(rows: DataFrame, batch: int) -> None:
        _advance(spark, path, batch, start, lambda tables: change(tables, rows))

    return _start(assets, path, step, every, once)


def stream_results(
    results: DataFrame, path: str, start: str, every: str = "30s", once: bool = False
) -> StreamingQuery:
    """Ingest arriving results ``(custom_id, reply, error)``, every work id once.

    An id whose outcome is on record is left out, as are repeats within a micro-batch, where a
    usable reply goes before an error. A batch closes with the micro-batch that brings the last of
    its outcomes.
    """
    spark = results.sparkSession

    def change(tables: dict[str, DataFrame], rows: DataFrame) -> dict[str, DataFrame]:
        recorded = tables["batch_items"].filter("result is not null or error is not null")
        fresh = rows.join(recorded.select("custom_id"), "custom_id", "left_anti")
        return ingest_results(fresh, tables, F.current_timestamp())[0]

    def step(rows: DataFrame, batch: int) -> None:
        _advance(spark, path, batch, start, lambda tables: change(tables, rows))

    return _start(results, path, step, every, once)


def latest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables after the last micro-batch whose version is committed; none yet is an error."""
    done = versions(spark, f"{path}/tables")
    if not done:
        raise FileNotFoundError(f"no committed version of the tables at {path}")
    return load_tables(spark, version(path, done[-1]))
