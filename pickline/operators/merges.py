"""Merging new verdicts, decisions and stamps into tables.

Plain parquet has no row updates, so a merge yields the table's next version. Updates are reduced to
one row per key. A Bloom filter of their keys, built by aggregation and broadcast, tells which rows of
the table may be updated: only these are shuffled to a full outer join with the updates, the others
stay where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickline.functions.scalars import work_kind
from pickline.schemas import BATCH_ITEMS, BATCHES, BURSTS, DECISIONS, TRIAGE, align


#: Blocks of the filter of update keys and bits of each: 4 MB, sparse up to about two million keys.
FILTER_BLOCKS, BLOCK_BITS = 1024, 32_768


def last_per_key(updates: DataFrame, key: str, seq: str) -> DataFrame:
    """The row with the greatest ``seq`` per key, combined map-side."""
    rest = [c for c in updates.columns if c not in (key, seq)]
    if not rest:
        return updates.select(key).distinct()
    # in a struct a null is the least value, where a bare null would hide its row
    return updates.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.struct(seq)).alias("_r")).select(key, "_r.*")


def one_per_key(updates: DataFrame, key: str) -> DataFrame:
    """One row per key, of several the greatest by all other columns in their order."""
    rest = [c for c in updates.columns if c != key]
    if not rest:
        return updates.select(key).distinct()
    return updates.groupBy(key).agg(F.max(F.struct(*rest)).alias("_r")).select(key, "_r.*")


def _filter_bits(key: str) -> tuple[Column, list[Column]]:
    """The block of a key in the filter, and its bits there."""
    h = F.xxhash64(key)
    bits = [F.shiftrightunsigned(h, s).bitwiseAND(F.lit(BLOCK_BITS - 1).cast("bigint")) for s in (10, 25, 40)]
    return F.pmod(h, F.lit(FILTER_BLOCKS)).cast("int"), bits


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """``(block, bits)``: a blocked Bloom filter of a key column, at most 1,024 rows of 4 KB."""
    block, bits = _filter_bits(key)
    return keys.select(block.alias("block"), F.explode(F.array(*bits)).alias("bit")).groupBy("block").agg(
        F.bitmap_construct_agg("bit").alias("bits"))


def split_by_filter(target: DataFrame, updates: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``target`` whose key may be among the updates', and those whose key is not."""
    block, bits = _filter_bits("key")
    packed = target.select(F.col(key).alias("key"), F.struct(*target.columns).alias("row"))
    keys = updates.select(F.col(key).cast(target.schema[key].dataType).alias(key))  # types hash differently
    looked_up = packed.join(
        F.broadcast(key_filter(keys, key)), block == F.col("block"), "left")

    def is_set(bit: Column) -> Column:
        at = F.floor(bit / 8).cast("int")
        byte = F.conv(F.hex(F.substring(F.col("bits"), at + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, (bit % 8).cast("int")) == 1

    found = F.coalesce(is_set(bits[0]) & is_set(bits[1]) & is_set(bits[2]), F.lit(False))
    return looked_up.filter(found).select("row.*"), looked_up.filter(~found).select("row.*")


def merge_upsert(
    target: DataFrame,
    updates: DataFrame,
    key: str,
    seq: str | None = None,
    overrides: dict[str, Column] | None = None,
) -> DataFrame:
    """Insert or update by key; only columns present in ``updates`` are written.

    ``seq`` orders several updates of one key, the last one wins; without it the greatest row does,
    so the key stays unique either way. ``updates`` are read twice, for the filter and for the join; with
    millions of them the filter lets more rows pass than it must, which costs shuffling, not results.
    ``overrides`` computes a column of updated or inserted rows from ``old`` and ``new`` structs.
    """
    updates = one_per_key(updates, key) if seq is None else last_per_key(updates, key, seq)
    written = [c for c in target.columns if c in updates.columns and c != key]
    near, rest = split_by_filter(target, updates, key)
    old = near.select(key, F.struct(*[c for c in target.columns if c != key]).alias("old"))
    new = updates.select(key, F.struct(*[F.col(c) for c in written] or [F.lit(1).alias("_")])
                         .alias("new"))
    kinds = {f.name: f.dataType for f in target.schema}
    touched = F.col("new").isNotNull()
    columns = []
    for c in target.columns:
        if c == key:
            columns.append(F.col(key))
            continue
        value = F.col(f"old.{c}")
        if overrides and c in overrides:
            value = F.when(touched, overrides[c].cast(kinds[c])).otherwise(value)
        elif c in written:
            value = F.when(touched, F.col(f"new.{c}").cast(kinds[c])).otherwise(value)
        columns.append(value.alias(c))
    return old.join(new, key, "full_outer").select(*columns).unionByName(rest)


def merge_triage(triage: DataFrame, verdicts: DataFrame, seq: str | None = None) -> DataFrame:
    """Replace verdicts; blank captions and empty keyword lists are null, the stamp is reset."""
    rows = verdicts
    if "caption" in rows.columns:
        rows = rows.withColumn("caption", F.when(F.col("caption") != "", F.col("caption")))
    if "keywords" in rows.columns:
        rows = rows.withColumn("keywords", F.when(F.size("keywords") > 0, F.col("keywords")))
    if seq is not None:
        rows = last_per_key(rows, "asset_id", seq)
    return merge_upsert(triage, align(rows, TRIAGE), "asset_id",
                        overrides={"enriched_at": F.lit(None)})


def merge_bursts(bursts: DataFrame, verdicts: DataFrame, seq: str | None = None) -> DataFrame:
    """Replace group verdicts; ``applied_at`` stays only for the same winner and ordered losers."""
    rows = verdicts if seq is None else last_per_key(verdicts, "burst_id", seq)
    same = F.col("old.winner_id").eqNullSafe(F.col("new.winner_id")) & F.col(
        "old.reject_ids"
    ).eqNullSafe(F.col("new.reject_ids"))
    return merge_upsert(bursts, align(rows, BURSTS), "burst_id",
                        overrides={"applied_at": F.when(same, F.col("old.applied_at"))})


def merge_decisions(
    decisions: DataFrame, updates: DataFrame, seq: str | None = None
) -> DataFrame:
    """Replace decisions; ``applied_at`` stays only where the bucket is unchanged."""
    rows = updates if seq is None else last_per_key(updates, "asset_id", seq)
    same = F.col("old.bucket").eqNullSafe(F.col("new.bucket"))
    return merge_upsert(decisions, align(rows, DECISIONS), "asset_id",
                        overrides={"applied_at": F.when(same, F.col("old.applied_at"))})


def pick_winners(groups: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """1-based picks as ids: ``(burst_id, winner_id, reject_ids, ..)`` and rows out of range.

    Losers keep the order of the verdict, without repeats, foreign indices and the winner.
    """
    rows = groups.join(verdicts, "burst_id")
    size = F.size("member_ids")
    inside = F.col("best_index").between(1, size)
    winner = F.get("member_ids", F.col("best_index") - 1)
    named = F.transform(
        F.filter(F.array_distinct("reject_indices"), lambda i: i.between(1, size)),
        lambda i: F.get(F.col("member_ids"), i - 1),
    )
    picked = rows.filter(inside).withColumn("winner_id", winner).withColumn(
        "reject_ids", F.filter(named, lambda m: m != F.col("winner_id"))
    )
    failed = rows.filter(~F.coalesce(inside, F.lit(False))).withColumn(
        "error", F.lit("best_index out of range")
    )
    return picked.drop("best_index", "reject_indices"), failed


def resolve_bursts(
    groups: DataFrame, verdicts: DataFrame, bursts: DataFrame, decisions: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply group verdicts: next ``bursts``, next ``decisions`` and the failed verdicts.

    Every loser gets a ``burst_loser`` decision. A kept member loses a ``burst_loser`` decision
    that an earlier verdict left behind.
    """
    picked, failed = pick_winners(groups, verdicts)
    model = F.col("model") if "model" in picked.columns else F.lit(None).cast("string")
    picked = picked.withColumn("model", model)
    next_bursts = merge_bursts(bursts, picked.withColumn("judged_at", now))
    losers = picked.select(
        F.explode("reject_ids").alias("asset_id"),
        F.lit("burst_loser").alias("bucket"),
        F.to_json(F.struct("burst_id", "winner_id", "note")).alias("detail"),
        now.alias("decided_at"),
    )
    # an asset lies in one group; should groups overlap, the last group by its key decides
    losers = last_per_key(
        losers.withColumn("_k", F.get_json_object("detail", "$.burst_id")), "asset_id", "_k"
    )
    kept = picked.select(F.explode("member_ids").alias("asset_id")).distinct().join(
        losers.select("asset_id"), "asset_id", "left_anti"
    )
    stale = decisions.filter(F.col("bucket") == "burst_loser").select("asset_id").join(
        kept, "asset_id", "left_semi"
    )
    next_decisions = merge_decisions(decisions.join(stale, "asset_id", "left_anti"), losers)
    return next_bursts, next_decisions, failed


def mark_done(
    df: DataFrame, key: str, done: DataFrame, column: str = "applied_at", now: Column | None = None
) -> DataFrame:
    """Stamp ``column`` for the keys in ``done``; unknown keys are ignored."""
    ids = done.select(key).distinct().withColumn("_done", F.lit(True))
    stamp = F.current_timestamp() if now is None else now
    return df.join(ids, key, "left").withColumn(
        column, F.when(F.col("_done"), stamp).otherwise(F.col(column))
    ).select(*df.columns)


def count_done(df: DataFrame, key: str, done: DataFrame) -> DataFrame:
    """How many rows :func:`mark_done` changes, as one row ``changed``."""
    return df.join(done.select(key), key, "left_semi").agg(F.count("*").alias("changed"))


def clear_decisions(decisions: DataFrame, keys: DataFrame) -> DataFrame:
    """Decisions without the given assets'."""
    return decisions.join(keys.select("asset_id"), "asset_id", "left_anti")


def register_batch(
    items: DataFrame, batches: DataFrame, queued: DataFrame, kind: str, now: Column
) -> tuple[DataFrame, DataFrame]:
    """Record submitted work ``(custom_id, batch_id, payload)``: next items and next batches.

    An item that is queued again moves to the new batch and loses its old outcome.
    """
    rows = queued.select(
        "custom_id", "batch_id",
        work_kind(F.col("custom_id"), F.lit(kind)).alias("kind"), "payload",
        F.lit(None).cast("string").alias("result"), F.lit(None).cast("string").alias("error"),
    )
    jobs = queued.select("batch_id").distinct().select(
        "batch_id", F.lit(kind).alias("kind"), F.lit("submitted").alias("status"),
        now.alias("submitted_at"),
    )
    return (
        merge_upsert(align(items, BATCH_ITEMS), rows, "custom_id"),
        merge_upsert(align(batches, BATCHES), jobs, "batch_id"),
    )


def set_batch_status(
    batches: DataFrame, ids: DataFrame, status: str, now: Column
) -> DataFrame:
    """Change the status of the given batches; ``ingested`` also stamps the time."""
    rows = ids.select("batch_id").distinct().withColumn("_hit", F.lit(True))
    joined = batches.join(rows, "batch_id", "left").withColumn(
        "status", F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status"))
    )
    if status == "ingested":
        joined = joined.withColumn(
            "ingested_at", F.when(F.col("_hit"), now).otherwise(F.col("ingested_at"))
        )
    return joined.select(*batches.columns)


