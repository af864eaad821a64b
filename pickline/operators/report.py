"""Counters, cost and the tables of a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickline.functions.scalars import reasons_line, score_line, verdict_line
from pickline.operators.skew import broadcast_if_small

# Headline counters in order, as (label, metric).
HEADLINES = (
    ("Assets scanned", "assets"), ("Triaged", "triage"), ("Awaiting triage", "untriaged"),
    ("Burst groups", "burst_groups"), ("Rejects", "bucket:reject"),
    ("Non-photos", "bucket:nonphoto"), ("Burst also-rans", "bucket:burst_loser"),
    ("Left in the middle", "bucket:middle"), ("Five star", "bucket:five_star"),
    ("Four star", "bucket:four_star"), ("Three star", "bucket:three_star"),
    ("Two star", "bucket:two_star"), ("One star", "bucket:one_star"),
    ("Best-worst sets", "bws_sets"), ("Head-to-heads", "pairs"),
    ("Decisions written back", "applied"), ("Decisions pending", "unapplied"),
)


def _metric(name: str, df: DataFrame, value=None) -> DataFrame:
    value = F.count("*") if value is None else value
    return df.agg(value.cast("bigint").alias("value")).select(F.lit(name).alias("metric"), "value")


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """``(metric, value)``: rows per table, live groups, untriaged, applied, open batches."""
    decisions, batches = tables["decisions"], tables["batches"]
    untriaged = tables["assets"].select(F.col("id").alias("asset_id")).join(
        tables["triage"].select("asset_id"), "asset_id", "left_anti"
    )
    parts = [_metric(name, df) for name, df in tables.items()]
    parts += [
        # groups repeat per member: distinct first keeps the exact count spread over tasks
        _metric("burst_groups", tables["assets"].filter("burst_id is not null")
                .select("burst_id").distinct()),
        _metric("untriaged", untriaged),
        _metric("applied", decisions, F.count("applied_at")),
        _metric("unapplied", decisions, F.count_if(F.col("applied_at").isNull())),
        _metric("open_batches", batches, F.count_if(F.col("ingested_at").isNull())),
    ]
    return reduce(DataFrame.unionByName, parts)


def breakdown(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, nulls left out."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def triage_stats(singles: DataFrame, bursts: DataFrame, errors: DataFrame) -> DataFrame:
    """Counters of a judging run as one row.

    ``singles`` holds ``bucket, verdict, input_tokens, output_tokens``, ``bursts`` ``reject_ids``
    and the token columns, ``errors`` one row per failed item.
    """
    def tokens(*columns: str) -> list:
        return [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in columns]

    used = ("input_tokens", "output_tokens")
    parts = [
        singles.agg(
            F.count("*").alias("singles_judged"),
            F.count_if(F.col("bucket") == "reject").alias("rejects"),
            F.count_if(F.col("bucket") == "nonphoto").alias("nonphotos"),
            F.count_if(F.col("bucket") == "middle").alias("middles"),
            F.count_if(F.col("verdict") == "candidate").alias("candidates"),
            *tokens(*used),
        ),
        bursts.agg(
            F.count("*").alias("bursts_judged"),
            F.coalesce(F.sum(F.size("reject_ids").cast("bigint")), F.lit(0)).alias("burst_losers"),
            *tokens(*used),
        ),
        errors.agg(F.count("*").alias("errors")),
    ]
    # three one-row aggregates, added up by column
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.agg(*tokens(
        "bursts_judged", "burst_losers", "singles_judged", "rejects", "nonphotos", "candidates",
        "middles", "errors", *used,
    ))


def price_join(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Add the price of the longest prefix of each model name; no match leaves nulls.

    ``prices`` is ``(prefix, price_in, price_out)``. Only distinct names are matched, by one
    equi-join per prefix length that occurs, so neither side is paired with all of the other.
    """
    names = usage.select("model").distinct()
    # prefix lengths are bounded by the length of a model name
    cuts = names.withColumn(
        "prefix",
        F.explode(F.transform(F.sequence(F.lit(0), F.length("model")),
                              lambda n: F.substring(F.col("model"), F.lit(1), n))),
    )
    best = cuts.join(prices, "prefix").groupBy("model").agg(
        F.max_by(F.struct("prefix", "price_in", "price_out"), F.length("prefix")).alias("p")
    ).select("model", "p.*")
    rows = best.count()
    return usage.join(broadcast_if_small(best, rows), "model", "left")


def cost_by_model(usage: DataFrame, prices: DataFrame, batch: str = "batch") -> DataFrame:
    """Cost per model in the prices' currency per million tokens; batch use costs half.

    A model without a price has a null cost.
    """
    totals = usage.groupBy("model", batch).agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")
    )
    cost = (F.col("input_tokens") / 1_000_000 * F.col("price_in")
            + F.col("output_tokens") / 1_000_000 * F.col("price_out"))
    priced = price_join(totals, prices).withColumn(
        "cost", F.when(F.col(batch), cost / 2).otherwise(cost)
    )
    return priced.groupBy("model").agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost").alias("cost"),
    )


def report_captions(
    assets: DataFrame, triage: DataFrame, scores: DataFrame, decisions: DataFrame
) -> DataFrame:
    """The text lines of a card for every decided asset."""
    rows = (
        decisions.select("asset_id", "bucket")
        .join(assets.select(F.col("id").alias("asset_id"), "filename"), "asset_id", "left")
        .join(scores.select("asset_id", "bt_score", "rank", "stars"), "asset_id", "left")
        .join(triage.select("asset_id", "verdict", "technical_score", "confidence", "reasons"),
              "asset_id", "left")
    )
    return rows.select(
        "asset_id", "bucket",
        F.coalesce(F.when(F.col("filename") != "", F.col("filename")), "asset_id").alias("title"),
        score_line(F.col("stars"), F.col("rank"), F.col("bt_score")).alias("score_line"),
        verdict_line(F.col("verdict"), F.col("technical_score"), F.col("confidence"))
        .alias("verdict_line"),
        reasons_line(F.col("reasons")).alias("reasons_line"),
    )


def report_keepers(
    decisions: DataFrame, scores: DataFrame, assets: DataFrame, triage: DataFrame
) -> DataFrame:
    """Five- then four-star items by rank, unranked ones last."""
    keepers = decisions.filter(F.col("bucket").isin("five_star", "four_star")).select(
        "asset_id", "bucket"
    )
    return (
        keepers.join(scores.select("asset_id", "bt_score", "rank", "stars"), "asset_id", "left")
        .join(assets.select(F.col("id").alias("asset_id"), "filename"), "asset_id", "left")
        .join(triage.select("asset_id", "reasons"), "asset_id", "left")
        .orderBy(F.when(F.col("bucket") == "five_star", 0).otherwise(1),
                 F.col("rank").asc_nulls_last(), "asset_id")
    )


def _decided(decisions: DataFrame, triage: DataFrame, assets: DataFrame, bucket: str) -> DataFrame:
    return (
        decisions.filter(F.col("bucket") == bucket).select("asset_id")
        .join(triage.select("asset_id", "category", "verdict", "technical_score", "confidence",
                            "reasons"), "asset_id", "left")
        .join(assets.select(F.col("id").alias("asset_id"), "filename"), "asset_id", "left")
    )


def report_rejects(decisions: DataFrame, triage: DataFrame, assets: DataFrame) -> DataFrame:
    """Rejects by score then id; a missing score counts as 0."""
    return _decided(decisions, triage, assets, "reject").orderBy(
        F.coalesce("technical_score", F.lit(0)), "asset_id"
    )


def report_nonphotos(decisions: DataFrame, triage: DataFrame, assets: DataFrame) -> DataFrame:
    """Non-photos by category then id."""
    return _decided(decisions, triage, assets, "nonphoto").orderBy(
        F.coalesce("category", F.lit("")), "asset_id"
    )


def report_bursts(assets: DataFrame, bursts: DataFrame) -> DataFrame:
    """Every live group's members in order, with their role and the note."""
    verdicts = bursts.select("burst_id", "winner_id", "reject_ids", "note")
    rows = assets.filter(F.col("burst_id").isNotNull()).select("burst_id", "taken_at", "id").join(
        verdicts, "burst_id", "left"
    )
    role = F.when(F.col("id") == F.col("winner_id"), "winner").when(
        F.array_contains("reject_ids", F.col("id")), "loser"
    )
    return rows.select(
        "burst_id", "taken_at", F.col("id").alias("asset_id"), role.alias("role"), "note"
    ).orderBy("burst_id", "taken_at", "asset_id")


def report_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """The headline counters as ``(ord, label, value)``; absent ones are 0."""
    values = summary(tables).unionByName(
        breakdown(tables["decisions"], "bucket").select(
            F.concat(F.lit("bucket:"), "bucket").alias("metric"), F.col("n").alias("value")
        )
    )
    spark = tables["decisions"].sparkSession
    labels = spark.createDataFrame(
        [(i + 1, label, metric) for i, (label, metric) in enumerate(HEADLINES)],
        "ord int, label string, metric string",
    )
    return labels.join(values, "metric", "left").select(
        "ord", "label", F.coalesce("value", F.lit(0)).alias("value")
    ).orderBy("ord")
