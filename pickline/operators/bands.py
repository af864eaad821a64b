"""From strengths to star bands: pools, anchors, bands, and who is exempt from losing stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickline.operators.ordering import top_n, with_position
from pickline.schemas import STAR_BUCKETS


def by_strength(score: str = "bt_score", key: str = "asset_id") -> list[Column]:
    """Strongest first, ties by id."""
    return [F.col(score).desc_nulls_last(), F.col(key)]


def cap_candidates(
    cands: DataFrame, scores: DataFrame, limit: int | None, key: str = "asset_id"
) -> DataFrame:
    """Candidates that enter scoring: ``(asset_id, bt_score)``.

    All unscored ones, and up to ``limit`` scored ones evenly spaced by strength as anchors; a
    limit of one keeps the strongest, none or zero keeps all.
    """
    known = scores.filter(F.col("bt_score").isNotNull()).select(key, "bt_score")
    extra = [c for c in ("technical_score",) if c in cands.columns]
    rows = cands.select(key, *extra).join(known, key, "left")
    if not limit or limit <= 0:
        return rows.select(key, "bt_score")
    ties = [F.col(c).desc() for c in extra]
    placed = with_position(
        rows.filter(F.col("bt_score").isNotNull()), F.col("bt_score").desc(), *ties, F.col(key)
    )
    n = placed.count()
    if limit == 1:
        picks = cands.sparkSession.range(1).withColumnRenamed("id", "position")
    else:
        # positions come from a range of the option's size, not from the data
        spread = F.bround(F.col("id") * F.lit(n - 1) / F.lit(limit - 1)).cast("bigint")
        picks = cands.sparkSession.range(limit).select(
            (F.col("id") if n <= limit else spread).alias("position")
        ).distinct()
    anchors = placed.join(picks, "position", "left_semi")
    return rows.filter(F.col("bt_score").isNull()).select(key, "bt_score").unionByName(
        anchors.select(key, "bt_score")
    )


def five_target(scores: DataFrame, fraction: float = 0.05, five_count: int | None = None) -> int:
    """How many items get five stars: the given count, or a share of the scored items, at least 1."""
    if five_count is not None:
        return five_count
    n = scores.filter(F.col("bt_score").isNotNull()).count()
    return max(1, round(n * fraction))


def top_pool(scores: DataFrame, five: int, floor: int = 50) -> DataFrame:
    """The strongest ``max(floor, 2 * five)`` scored items."""
    scored = scores.filter(F.col("bt_score").isNotNull()).select("asset_id", "bt_score")
    return top_n(scored, max(floor, 2 * five, 0), ("bt_score", False), ("asset_id", True))


def _banded(placed: DataFrame, fives: int, fours: int, rest: int | None) -> DataFrame:
    stars = F.when(F.col("position") < fives, 5).when(F.col("position") < fives + fours, 4)
    if rest is not None:
        stars = stars.otherwise(rest)
    return placed.withColumn("stars", stars.cast("int"))


def star_bands(
    ranked: DataFrame, five_count: int, four_frac: float = 0.3, full: bool = False
) -> DataFrame:
    """Stars of ``(asset_id, bt_score)``: top ``five_count`` get 5, a share of the rest 4.

    The share is truncated and both inputs are clamped. Items below get null, or 3 with ``full``.
    """
    placed = with_position(ranked, *by_strength())
    n = placed.count()
    fives = max(0, min(int(five_count), n))
    fours = int((n - fives) * min(max(four_frac, 0.0), 1.0))
    return _banded(placed, fives, fours, 3 if full else None)


def fraction_bands(
    ranked: DataFrame,
    five: float = 0.05,
    four: float = 0.15,
    full: bool = False,
    n_scored: int | None = None,
    five_count: int | None = None,
) -> DataFrame:
    """Stars by shares of the scored items, rounded half to even; at least one five.

    ``n_scored`` and ``five_count`` replace the number of ranked rows and the five-star share.
    """
    placed = with_position(ranked, *by_strength())
    n = placed.count()
    scored = n if n_scored is None else n_scored
    fives = max(1, round(scored * five)) if five_count is None else five_count
    return _banded(placed, min(fives, n), round(scored * four), 3 if full else None)


def prior_fives(scores: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items that ever earned five stars here: by score row or by decision."""
    return scores.filter("stars = 5").select("asset_id").unionByName(
        decisions.filter("bucket = 'five_star'").select("asset_id")
    ).distinct()


def external_fives(assets: DataFrame, prior: DataFrame) -> DataFrame:
    """Items rated five at the source and never awarded here."""
    return assets.filter("source_rating = 5").select(F.col("id").alias("asset_id")).distinct() \
        .join(prior, "asset_id", "left_anti")


def _flagged(df: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    marks = ids.select("asset_id").distinct().withColumn(name, F.lit(True))
    return df.join(marks, "asset_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def protect_fives(bands: DataFrame, prior: DataFrame, external: DataFrame) -> DataFrame:
    """Earlier fives that are still ranked go back to 5; external fives never go lower.

    ``bands`` holds every ranked item with ``stars`` null when unstarred. An external five below 5
    is left alone, so its stars become null. Adds ``protected`` and ``exempt``.
    """
    rows = _flagged(_flagged(bands, prior, "_prior"), external, "_external")
    lower = F.coalesce("stars", F.lit(0)) < 5
    return rows.select(
        *[c for c in bands.columns if c != "stars"],
        F.when(F.col("_prior"), 5)
        .when(F.col("_external") & lower, F.lit(None))
        .otherwise(F.col("stars")).cast("int").alias("stars"),
        (F.col("_prior") & lower).alias("protected"),
        (F.col("_prior") | F.col("_external")).alias("exempt"),
    )


def demoted(bands: DataFrame) -> DataFrame:
    """Ranked items outside the bands that are not exempt."""
    exempt = F.col("exempt") if "exempt" in bands.columns else F.lit(False)
    return bands.filter(F.col("stars").isNull() & ~exempt).select("asset_id")


def retract_stars(
    scores: DataFrame, decisions: DataFrame, bands: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Take stars and star decisions from ranked items outside the bands, exempt ones excluded."""
    gone = demoted(bands)
    flagged = _flagged(scores, gone, "_gone")
    next_scores = flagged.withColumn(
        "stars", F.when(~F.col("_gone"), F.col("stars"))
    ).select(*scores.columns)
    flagged = _flagged(decisions, gone, "_gone")
    starred = F.coalesce(F.col("bucket").isin(*STAR_BUCKETS.values()), F.lit(False))
    return next_scores, flagged.filter(~(F.col("_gone") & starred)).select(*decisions.columns)


def star_bucket(stars: Column) -> Column:
    """The decision bucket of a star count."""
    bucket = F.lit(None).cast("string")
    for count, name in STAR_BUCKETS.items():
        bucket = F.when(stars == count, name).otherwise(bucket)
    return bucket


def star_tail(
    triage: DataFrame,
    decisions: DataFrame,
    bands: DataFrame,
    skip_buckets: tuple[str, ...] | None = ("middle",),
    exempt: DataFrame | None = None,
) -> DataFrame:
    """Stars for photos outside the ranking: 2 for a score of at least 5, else 1.

    Photos with a decision are left out. Every judged photo has at least a ``middle`` decision,
    so decisions in ``skip_buckets`` do not count; ``None`` makes every decision count. Photos in
    ``exempt``, such as those with five stars from elsewhere, are left alone as well.
    """
    decided = decisions
    if skip_buckets:
        decided = decisions.filter(~F.col("bucket").isin(*skip_buckets))
    starred = bands.filter(F.col("stars").isNotNull()).select("asset_id")
    if exempt is not None:
        starred = starred.unionByName(exempt.select("asset_id"))
    score = F.coalesce("technical_score", F.lit(0))
    return (
        triage.filter("category = 'photo'").select("asset_id", score.alias("technical_score"))
        .join(decided.select("asset_id"), "asset_id", "left_anti")
        .join(starred, "asset_id", "left_anti")
        .withColumn("stars", F.when(F.col("technical_score") >= 5, 2).otherwise(1))
    )


def band_decisions(bands: DataFrame, now: Column) -> DataFrame:
    """Decisions for starred items, with their place in the ranking."""
    return bands.filter(F.col("stars").isNotNull()).select(
        "asset_id",
        star_bucket(F.col("stars")).alias("bucket"),
        F.to_json(F.struct("stars", (F.col("position") + 1).alias("rank"))).alias("detail"),
        now.alias("decided_at"),
    )


def tail_decisions(tail: DataFrame, now: Column) -> DataFrame:
    """Decisions for the tail of the star spectrum."""
    return tail.select(
        "asset_id",
        star_bucket(F.col("stars")).alias("bucket"),
        F.to_json(F.struct("stars", F.lit("triage").alias("from"), "technical_score"))
        .alias("detail"),
        now.alias("decided_at"),
    )
