"""Running a user's judge over items, and ingesting finished results."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickline.functions.replies import checked, parse_replies
from pickline.functions.scalars import triage_bucket, work_key, work_kind
from pickline.operators.groups import group_members
from pickline.operators.merges import (
    last_per_key, merge_decisions, merge_triage, merge_upsert, resolve_bursts, set_batch_status,
)
from pickline.session import cut

#: Stop reasons after which the same request cannot succeed.
TERMINAL_STOPS = ("refusal", "max_tokens")
#: Items that one task asks about, and whose replies it reads.
ASKED_PER_TASK = 20_000

Judge = Callable[[dict[str, Any]], dict[str, Any]]


class FatalJudgeError(Exception):
    """Raised by a judge to end the whole job, for example on a rejected credential."""


def _ask(items: DataFrame, fn: Judge) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies = []
            for row in frame.to_dict("records"):
                try:
                    reply = fn(row)
                except FatalJudgeError:
                    raise
                except (OSError, ValueError, RuntimeError) as exc:  # this item only
                    reply = {"call_error": f"{type(exc).__name__}: {exc}"}
                replies.append((
                    reply.get("text"), int(reply.get("input_tokens") or 0),
                    int(reply.get("output_tokens") or 0), reply.get("stop_reason"),
                    reply.get("call_error"),
                ))
            frame["reply"], frame["input_tokens"], frame["output_tokens"], frame["stop_reason"], \
                frame["call_error"] = zip(*replies, strict=True) if replies else ([],) * 5
            yield frame

    return items.mapInPandas(
        run, f"{fields}, reply string, input_tokens bigint, output_tokens bigint, "
             "stop_reason string, call_error string"
    )


def judge_with(
    items: DataFrame,
    fn: Judge,
    kind: str,
    max_retries: int = 1,
    count: Column | None = None,
) -> DataFrame:
    """Ask ``fn`` about every item in parallel and return typed verdicts.

    ``fn`` maps a row to ``{"text", "input_tokens", "output_tokens", "stop_reason"}``. Replies
    that cannot be used are asked for again up to ``max_retries`` times, as one further pass over
    only those items; refusals, truncations and failed calls are not. Rows that stay unusable
    have ``error`` set; a :class:`FatalJudgeError` ends the job. Every pass is written before it
    is read, since a reply is paid for and may differ the next time; so is what its replies say,
    which many tables follow from. However few files the items lie in, tasks ask about at most
    ``ASKED_PER_TASK`` of them each. Tokens of an unusable reply are not counted.
    """
    columns = items.columns
    done, todo = None, items
    for left in range(max(0, max_retries), -1, -1):
        n = todo.count()
        if done is not None and not n:
            break
        if n > ASKED_PER_TASK:
            todo = todo.repartition(math.ceil(n / ASKED_PER_TASK))
        asked = cut(_ask(todo, fn))
        read = cut(checked(parse_replies(asked, kind), kind, count))
        stopped = F.col("stop_reason").isin(*TERMINAL_STOPS)
        read = read.withColumn(
            "error",
            F.coalesce(
                "call_error",
                F.when(stopped, F.concat(F.lit("stopped: "), "stop_reason")),
                "error",
            ),
        )
        again = F.col("error").isNotNull() & F.col("call_error").isNull() & ~F.coalesce(
            stopped, F.lit(False)
        )
        final = read if left == 0 else read.filter(~again)
        done = final if done is None else done.unionByName(final)
        if left:
            todo = read.filter(again).select(*columns)
    failed = F.col("error").isNotNull()
    for c in ("input_tokens", "output_tokens"):
        done = done.withColumn(c, F.when(failed, 0).otherwise(F.col(c)).cast("bigint"))
    return done.drop("stop_reason", "call_error")


def single_decisions(verdicts: DataFrame, now: Column) -> DataFrame:
    """The decision each single verdict leads to."""
    return verdicts.select(
        "asset_id",
        triage_bucket(F.col("category"), F.col("verdict"), F.col("confidence")).alias("bucket"),
        F.to_json(F.struct("category", "verdict", "technical_score", "confidence", "reasons"))
        .alias("detail"),
        now.alias("decided_at"),
    )


def apply_singles(
    triage: DataFrame, decisions: DataFrame, verdicts: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """Record single verdicts and their decisions."""
    return (
        merge_triage(triage, verdicts.withColumn("judged_at", now)),
        merge_decisions(decisions, single_decisions(verdicts, now)),
    )


def route_results(results: DataFrame, items: DataFrame, default_kind: str = "triage") -> DataFrame:
    """Finished results with their routing: kind by work-id prefix, key from payload or id."""
    known = items.select("custom_id", "batch_id", "payload")
    rows = results.join(known, "custom_id", "left")
    kind = work_kind(F.col("custom_id"), F.lit(default_kind))
    key = F.coalesce(
        F.when(kind == "burst", F.get_json_object("payload", "$.burst_id")),
        F.when(kind != "burst", F.get_json_object("payload", "$.asset_id")),
        work_key(F.col("custom_id")),
    )
    return rows.withColumn("kind", kind).withColumn("key", key)


def one_result(results: DataFrame) -> DataFrame:
    """One result per work id: one without an error goes first, then the greatest.

    A column ``seq``, where there is one, comes before the text: the last result counts.
    """
    order = [c for c in ("seq", "reply", "error", "model") if c in results.columns]
    ranked = results.withColumn("_order", F.struct(F.col("error").isNull(), *order))
    return last_per_key(ranked, "custom_id", "_order")


def finished_batches(items: DataFrame, touched: DataFrame) -> DataFrame:
    """Of the ``touched`` batches those whose every item has a result or an error."""
    ids = touched.select("batch_id").distinct()
    waiting = items.filter("result is null and error is null").select("batch_id")
    return ids.join(waiting, "batch_id", "left_anti")


def ingest_results(
    results: DataFrame, tables: dict[str, DataFrame], now: Column, ended: bool = False
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Record finished results ``(custom_id, reply, error[, model][, seq])``.

    Group verdicts and single verdicts go to their tables with the decisions that follow; failed,
    missing or unusable replies become errors. Of several results of one work id one counts, see
    :func:`one_result`; of several usable ones for one target that of the greatest work id. Returns
    the next tables and the outcome per item ``(custom_id, kind, key, error)``. A batch is stamped
    as ingested once all its items have an outcome, or with its first results when it has
    ``ended`` and the missing ones will never come.
    """
    if "model" not in results.columns:
        results = results.withColumn("model", F.lit(None).cast("string"))
    results = one_result(results)
    routed = cut(route_results(results, tables["batch_items"]).withColumnRenamed(
        "error", "failed"
    ))
    usable = routed.filter(F.col("failed").isNull())
    singles = checked(parse_replies(usable.filter("kind <> 'burst'"), "triage"), "triage")
    # several tables follow from the parsed replies: parsed once
    singles = cut(singles.withColumnRenamed("key", "asset_id").withColumn("raw", F.col("reply")))
    good = last_per_key(singles.filter("error is null").withColumn("_seq", F.col("custom_id")),
                        "asset_id", "_seq")

    shown = usable.filter("kind = 'burst'").withColumn(
        "_members", F.from_json(F.get_json_object("payload", "$.member_ids"), "array<string>")
    )
    # members are looked up only for groups whose work item doesn't list them
    asked = shown.filter("_members is null").select(F.col("key").alias("burst_id")).distinct()
    live = group_members(tables["assets"].join(asked, "burst_id", "left_semi"))
    parsed = parse_replies(shown, "burst").withColumnRenamed("key", "burst_id").join(
        live.withColumnRenamed("member_ids", "_live"), "burst_id", "left"
    ).withColumn("member_ids", F.coalesce("_members", "_live", F.array().cast("array<string>")))
    groups = cut(checked(parsed, "burst", F.size("member_ids"), strict=False).drop(
        "_members", "_live"))
    won = last_per_key(groups.filter("error is null").withColumn("_seq", F.col("custom_id")),
                       "burst_id", "_seq")

    triage, decisions = apply_singles(tables["triage"], tables["decisions"], good, now)
    bursts, decisions, _ = resolve_bursts(
        won.select("burst_id", "member_ids"),
        won.select("burst_id", "best_index", "reject_indices", "note", "model"),
        tables["bursts"], decisions, now,
    )
    outcomes = (
        routed.filter("failed is not null").select(
            "custom_id", "kind", "key", F.col("failed").alias("error"), "reply")
        .unionByName(singles.select(
            "custom_id", "kind", F.col("asset_id").alias("key"), "error", "reply"))
        .unionByName(groups.select(
            "custom_id", "kind", F.col("burst_id").alias("key"), "error", "reply"))
    )
    recorded = outcomes.select(
        "custom_id", F.when(F.col("error").isNull(), F.col("reply")).alias("result"), "error"
    ).join(tables["batch_items"].select("custom_id"), "custom_id", "left_semi")
    items = cut(merge_upsert(tables["batch_items"], recorded, "custom_id"))
    touched = routed.filter("batch_id is not null")
    closed = touched if ended else finished_batches(items, touched)
    return {
        **tables,
        "triage": triage,
        "bursts": bursts,
        "decisions": decisions,
        "batch_items": items,
        "batches": set_batch_status(tables["batches"], closed, "ingested", now),
    }, outcomes.drop("reply")
