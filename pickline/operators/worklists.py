"""Incremental work lists: what still needs a verdict, and what to forget.

Every list is an anti- or semi-join on a key; keys are never null, so plain ``left_anti`` is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickline.functions.scalars import make_work_id
from pickline.operators.groups import group_members
from pickline.operators.ordering import segments, top_n
from pickline.schemas import NOT_CANDIDATES
from pickline.sources.assets import time_window


def unjudged(assets: DataFrame, triage: DataFrame, exclude_bursts: bool = True) -> DataFrame:
    """Ids of assets without a verdict, by default only ungrouped ones."""
    rows = assets.filter(F.col("burst_id").isNull()) if exclude_bursts else assets
    return rows.select("id", "taken_at").join(
        triage.select(F.col("asset_id").alias("id")), "id", "left_anti"
    )


def unjudged_bursts(assets: DataFrame, bursts: DataFrame) -> DataFrame:
    """Ids of live groups without a burst verdict."""
    live = assets.filter(F.col("burst_id").isNotNull()).select("burst_id").distinct()
    return live.join(bursts.select("burst_id"), "burst_id", "left_anti")


def inflight(items: DataFrame, batches: DataFrame) -> DataFrame:
    """Work ids that sit in a batch not ingested yet."""
    open_ = batches.filter(F.col("ingested_at").isNull()).select("batch_id")
    return items.join(open_, "batch_id", "left_semi").select("custom_id")


def _not_queued(df: DataFrame, kind: str, key: str, queued: DataFrame) -> DataFrame:
    named = df.withColumn("custom_id", F.concat(F.lit(f"{kind}_"), F.col(key)))
    return named.join(queued, "custom_id", "left_anti").drop("custom_id")


def pending_bursts(
    assets: DataFrame, bursts: DataFrame, items: DataFrame, batches: DataFrame
) -> DataFrame:
    """Ids of groups of two or more that have no verdict and are not queued."""
    sizes = assets.filter(F.col("burst_id").isNotNull()).groupBy("burst_id").agg(
        F.count("*").alias("n")
    )
    todo = sizes.filter("n >= 2").select("burst_id").join(
        bursts.select("burst_id"), "burst_id", "left_anti"
    )
    return _not_queued(todo, "burst", "burst_id", inflight(items, batches))


def pending_singles(
    assets: DataFrame, triage: DataFrame, bursts: DataFrame, items: DataFrame, batches: DataFrame
) -> DataFrame:
    """Ids of assets that still need a verdict of their own.

    These are ungrouped assets, members of groups that shrank to one, and members of judged
    groups that were not rejected; without what is judged or queued.
    """
    grouped = assets.filter(F.col("burst_id").isNotNull()).select("id", "burst_id")
    ungrouped = assets.filter(F.col("burst_id").isNull()).select("id")
    lone = grouped.groupBy("burst_id").agg(F.count("*").alias("n"), F.first("id").alias("id")) \
        .filter("n < 2").select("id")
    survivors = grouped.join(bursts.select("burst_id", "reject_ids"), "burst_id").filter(
        ~F.array_contains(F.coalesce("reject_ids", F.array().cast("array<string>")), F.col("id"))
    ).select("id")
    todo = ungrouped.unionByName(lone).unionByName(survivors).distinct().join(
        triage.select(F.col("asset_id").alias("id")), "id", "left_anti"
    )
    return _not_queued(todo, "triage", "id", inflight(items, batches))


def work_queue(
    bursts_todo: DataFrame, singles_todo: DataFrame, assets: DataFrame, limit: int | None = None
) -> DataFrame:
    """``(kind, key, custom_id)``, groups before single assets, at most ``limit`` items overall.

    Groups come by id, single assets by capture time and id. A work id that is not legal is null.
    """
    groups = bursts_todo.select(
        F.lit("burst").alias("kind"), F.lit(None).cast("timestamp").alias("taken_at"),
        F.col("burst_id").alias("key"),
    )
    singles = singles_todo.select("id").join(assets.select("id", "taken_at"), "id", "left").select(
        F.lit("triage").alias("kind"), F.col("taken_at").cast("timestamp").alias("taken_at"),
        F.col("id").alias("key"),
    )
    queue = groups.unionByName(singles).withColumn(
        "custom_id", make_work_id(F.col("kind"), F.col("key"))
    )
    order = ("kind", "taken_at", "key")
    ordered = queue.orderBy(*order) if limit is None else top_n(queue, limit, *[(c, True) for c in order])
    return ordered.select("kind", "key", "custom_id")


def candidates(triage: DataFrame, decisions: DataFrame, min_score: int = 8) -> DataFrame:
    """Photos called candidate or scoring at least ``min_score``, unless rejected or a loser."""
    good = triage.filter(
        (F.col("category") == "photo")
        & ((F.col("verdict") == "candidate") | (F.col("technical_score") >= min_score))
    )
    barred = decisions.filter(F.col("bucket").isin(*NOT_CANDIDATES)).select("asset_id")
    return good.join(barred, "asset_id", "left_anti").orderBy(
        F.col("technical_score").desc(), "asset_id"
    )


def unenriched(triage: DataFrame, assets: DataFrame) -> DataFrame:
    """Verdicts with a caption or keywords not written yet, with the source description."""
    rows = triage.filter(
        F.col("enriched_at").isNull()
        & (F.col("caption").isNotNull() | F.col("keywords").isNotNull())
    ).select("asset_id", "caption", "keywords")
    return rows.join(
        assets.select(F.col("id").alias("asset_id"), "description"), "asset_id"
    )


def rejudge_targets(
    assets: DataFrame,
    triage: DataFrame,
    decisions: DataFrame,
    after=None,
    before=None,
    bucket: str | None = None,
    missing_captions: bool = False,
) -> DataFrame:
    """Ids of judged assets that match all given filters."""
    rows = triage.filter(F.col("caption").isNull()) if missing_captions else triage
    rows = rows.select("asset_id")
    if bucket is not None:
        rows = rows.join(
            decisions.filter(F.col("bucket") == bucket).select("asset_id"), "asset_id", "left_semi"
        )
    known = time_window(assets, "taken_at", after, before).select(F.col("id").alias("asset_id"))
    return rows.join(known, "asset_id", "left_semi")


def forget_triage(
    triage: DataFrame, bursts: DataFrame, assets: DataFrame, targets: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Tables without the targets' verdicts and without verdicts of groups holding a target."""
    ids = targets.select("asset_id")
    touched = assets.filter(F.col("burst_id").isNotNull()).join(
        ids.withColumnRenamed("asset_id", "id"), "id", "left_semi"
    ).select("burst_id")
    return (
        triage.join(ids, "asset_id", "left_anti"),
        bursts.join(touched, "burst_id", "left_anti"),
    )


def forget_rank(
    sets: DataFrame, pairs: DataFrame, scores: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables without sets, rank pairs, strengths and ranks; stars stay."""
    return (
        sets.filter(F.lit(False)),
        pairs.filter(~F.col("stage").eqNullSafe("rank")),
        scores.withColumn("bt_score", F.lit(None).cast("double")).withColumn(
            "rank", F.lit(None).cast(scores.schema["rank"].dataType)
        ),
    )


def forget_finals(pairs: DataFrame) -> DataFrame:
    """Pairs without the head-to-heads of the finals."""
    return pairs.filter(~F.col("stage").eqNullSafe("finals"))


def unplanned_sets(planned: DataFrame, judged: DataFrame) -> DataFrame:
    """Planned sets without a recorded judgment, as a multiset difference.

    Of the planned copies ``(set_id, member_ids)`` with the same members, as many as were recorded
    drop out, the first ones first.
    """
    key = F.array_sort("member_ids")
    recorded = judged.groupBy(key.alias("key")).agg(F.count("*").alias("done"))
    copies = segments(
        planned.withColumn("key", key), [F.col("key"), F.col("set_id")],
        lambda p, t: p["key"] == t["key"], F.lit(0),
    )
    return copies.join(recorded, "key", "left").filter(
        F.col("pos") >= F.coalesce("done", F.lit(0))
    ).select(*planned.columns)


def decision_filter(
    decisions: DataFrame, bucket: str | None = None, unapplied_only: bool = False
) -> DataFrame:
    """Decisions of one bucket and/or not applied yet."""
    if bucket is not None:
        decisions = decisions.filter(F.col("bucket") == bucket)
    if unapplied_only:
        decisions = decisions.filter(F.col("applied_at").isNull())
    return decisions


def members_of(bursts_todo: DataFrame, assets: DataFrame) -> DataFrame:
    """Pending groups with their members in order."""
    return group_members(assets.join(bursts_todo.select("burst_id"), "burst_id", "left_semi"))
