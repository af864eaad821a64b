"""Declared tables, enumerations and options."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "double": T.DoubleType(), "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def _struct(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


ASSETS = _struct(
    id="string", filename="string", taken_at="timestamp", camera="string", description="string",
    width="int", height="int", burst_id="string", dhash="bigint", thumb_path="string",
    source_rating="int", scanned_at="timestamp",
)
TRIAGE = _struct(
    asset_id="string", category="string", verdict="string", technical_score="int",
    reasons="array<string>", caption="string", keywords="array<string>", enriched_at="timestamp",
    confidence="string", model="string", raw="string", judged_at="timestamp",
)
BURSTS = _struct(
    burst_id="string", winner_id="string", reject_ids="array<string>", note="string",
    model="string", judged_at="timestamp", applied_at="timestamp",
)
BWS_SETS = _struct(
    id="bigint", round="int", member_ids="array<string>", best_id="string", worst_id="string",
    model="string", judged_at="timestamp",
)
PAIRS = _struct(
    id="bigint", a_id="string", b_id="string", winner="string", stage="string", model="string",
    judged_at="timestamp",
)
SCORES = _struct(
    asset_id="string", bt_score="double", rank="bigint", stars="int", updated_at="timestamp",
)
DECISIONS = _struct(
    asset_id="string", bucket="string", detail="string", decided_at="timestamp",
    applied_at="timestamp",
)
BATCHES = _struct(
    batch_id="string", kind="string", status="string", submitted_at="timestamp",
    ingested_at="timestamp",
)
BATCH_ITEMS = _struct(
    custom_id="string", batch_id="string", kind="string", payload="string", result="string",
    error="string",
)

TABLES: dict[str, T.StructType] = {
    "assets": ASSETS, "triage": TRIAGE, "bursts": BURSTS, "bws_sets": BWS_SETS, "pairs": PAIRS,
    "scores": SCORES, "decisions": DECISIONS, "batches": BATCHES, "batch_items": BATCH_ITEMS,
}

# The enumerations of verdicts, work items and decisions.
CATEGORIES = ("photo", "screenshot", "document", "meme", "other")
VERDICTS = ("reject", "neutral", "candidate")
CONFIDENCES = ("low", "medium", "high")
PAIR_WINNERS = ("A", "B", "tie")
WORK_KINDS = ("triage", "burst", "bws", "pair")
TIE = "tie"
STAR_BUCKETS = {5: "five_star", 4: "four_star", 3: "three_star", 2: "two_star", 1: "one_star"}
NOT_CANDIDATES = ("reject", "burst_loser")


@dataclass(frozen=True)
class Options:
    """Options of a curation run; the defaults are fixed values."""

    burst_gap_seconds: float = 10.0
    burst_max_group: int = 10
    dhash_max_distance: int | None = 26
    bws_set_size: int = 8
    bws_appearances: int = 4
    seed: int = 20240601
    finals_rounds: int = 3
    finals_pool_size: int = 50
    five_star_fraction: float = 0.05
    four_star_fraction: float = 0.15
    five_count: int | None = None
    four_frac: float | None = None
    full_star_spectrum: bool = False
    allow_demotions: bool = False
    candidate_score_min: int = 8
    scoring_limit: int = 0
    album: str = "Five-Stars"
    album_min_stars: int = 5
    favorite_five: bool = True
    write_captions: bool = True
    keyword_tags: bool = False
    keyword_prefix: str = "kw"
    tag_root: str = "pickline"
    fit_iterations: int = 500
    fit_tol: float = 1e-8


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in the declared column order and types; missing columns are typed nulls."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema
    ])


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A table without rows."""
    return spark.createDataFrame([], schema)


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The whole table set without rows."""
    return {name: empty(spark, schema) for name, schema in TABLES.items()}
