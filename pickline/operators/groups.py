"""Bursts: chains of like frames, slices, and their union with known duplicate groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickline.functions.scalars import group_key, hamming
from pickline.operators.ordering import segments, with_position
from pickline.operators.skew import HOT_ROWS, attach
from pickline.session import cut


def _slices(runs: DataFrame, max_group: int, *columns: str) -> DataFrame:
    """Cut runs (``segment``, ``pos``, ``last``) into slices; a slice of one row is dropped."""
    if max_group < 2:
        raise ValueError(f"max_group must be at least 2, got {max_group}")
    return runs.withColumn("slice", F.floor(F.col("pos") / max_group)).withColumn(
        "pos", F.col("pos") % max_group
    ).filter(~(F.col("last") & (F.col("pos") == 0))).select(*columns, "segment", "slice", "pos")


def burst_chains(
    assets: DataFrame, gap_seconds: float = 10.0, max_distance: int | None = 26
) -> DataFrame:
    """Chains of consecutive frames per camera.

    A frame continues the chain when it follows its predecessor of the same camera by at most
    ``gap_seconds`` and, where both have a hash, differs by at most ``max_distance`` bits. Frames
    without a time are left out. Adds ``segment`` (chain number in order of camera and time),
    ``pos``, ``last`` and ``head`` (first frame's id). The order is cut by range, so a camera
    with a third of all frames is spread over many tasks.
    """
    frames = assets.filter(F.col("taken_at").isNotNull()).select(
        "id", "taken_at", F.coalesce("camera", F.lit("")).alias("camera"),
        F.col("dhash").cast("bigint").alias("dhash"),
    )
    gap = F.lit(int(round(gap_seconds * 1_000_000)))

    def micros(col):
        return F.unix_micros(col.cast("timestamp"))

    def linked(prev, this):
        near = (prev["camera"] == this["camera"]) & (
            micros(this["taken_at"]) - micros(prev["taken_at"]) <= gap
        )
        if max_distance is None:
            return near
        alike = hamming(prev["dhash"], this["dhash"]) <= max_distance
        return near & F.coalesce(alike, F.lit(True))

    return segments(
        frames, [F.col("camera"), F.col("taken_at"), F.col("id")], linked, F.col("id")
    )


def split_groups(chains: DataFrame, max_group: int = 10, *columns: str) -> DataFrame:
    """Consecutive slices of at most ``max_group``; ``(id[, columns], segment, slice, pos)``."""
    return _slices(chains, max_group, "id", *columns)


def burst_groups(
    assets: DataFrame,
    gap_seconds: float = 10.0,
    max_distance: int | None = 26,
    max_group: int = 10,
) -> DataFrame:
    """Chains cut into groups: ``(group_id, seq, member)``, ``seq`` ordering all members."""
    chains = burst_chains(assets, gap_seconds, max_distance)
    return split_groups(chains, max_group).select(
        F.concat_ws(".", F.lit("c"), "segment", "slice").alias("group_id"),
        F.struct("segment", "slice", "pos").alias("seq"),
        F.col("id").alias("member"),
    )


def known_duplicates(dups: DataFrame, assets: DataFrame) -> DataFrame:
    """Members of duplicate groups that are known assets, for groups keeping two or more.

    ``dups`` is either nested ``(duplicateId, assets: array<struct<id>>)`` or already one row per
    member ``(group_id, member)``.
    """
    if "assets" in dups.columns:
        dups = dups.select(
            F.col("duplicateId").alias("group_id"), F.posexplode("assets").alias("ord", "a")
        ).select("group_id", "ord", F.col("a.id").alias("member"))
    elif "ord" not in dups.columns:
        dups = dups.select("group_id", F.col("member").alias("ord"), "member")
    known = dups.join(
        assets.select(F.col("id").alias("member")), "member", "left_semi"
    )
    kept = known.groupBy("group_id").agg(F.count("*").alias("n")).filter("n >= 2")
    return attach(known, kept, "group_id", "n").select("group_id", "ord", "member")


def component_roots(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(v, root)`` for every vertex with an edge ``(hi, lo)``, root being the least vertex.

    Alternates two steps until the edges no longer change: every vertex hands the least of its
    neighbourhood to its larger neighbours, then to its smaller ones. Both keep connectivity and
    end in one star per component after a number of passes logarithmic in practice. A vertex that
    neighbours a third of the graph is joined by broadcast, see :func:`attach`.
    """
    edges = cut(edges.filter("hi > lo").distinct())
    mark = None
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(
            F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")
        )
        large = attach(both.filter("v > u"), least, "u", "n", hot_rows).select(
            F.col("v").alias("hi"), F.col("m").alias("lo")
        ).filter("hi > lo").distinct()
        large = cut(large)
        least = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
        small = attach(large, least, "hi", "n", hot_rows)
        edges = cut(
            small.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(small.select("hi", F.col("m").alias("lo")))
            .filter("hi > lo").distinct()
        )
        now = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")
        ).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("hi").alias("v"), F.col("lo").alias("root")).unionByName(
        edges.select(F.col("lo").alias("v"), F.col("lo").alias("root")).distinct()
    )


def merge_groups(
    groups: DataFrame,
    dup_groups: DataFrame,
    max_group: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Unite groups that share a member, transitively.

    ``groups`` is ``(group_id, seq, member)`` and ``dup_groups`` ``(group_id, ord, member)``;
    members are listed by first appearance, groups before duplicate groups, duplicate groups in
    order of their id. Returns ``(component, slice, pos, member)`` where ``component`` is the
    ordinal of the earliest member; ``max_group`` cuts consecutive slices.
    """
    first = groups.select(
        F.concat(F.lit("g"), F.col("group_id").cast("string")).alias("gid"), "seq", "member",
    )
    second = dup_groups.select(
        F.concat(F.lit("d"), F.col("group_id").cast("string")).alias("gid"),
        F.struct("group_id", "ord").alias("seq"), "member",
    )
    # one ordinal per member: its first appearance, bursts before duplicates
    seen = first.groupBy("member").agg(F.min("seq").alias("s1")).join(
        second.groupBy("member").agg(F.min("seq").alias("s2")), "member", "full_outer"
    )
    ordinals = cut(with_position(
        seen, F.col("s1").asc_nulls_last(), F.col("s2").asc_nulls_last(), F.col("member"),
        name="v",
    ).select("member", "v"))
    rows = cut(first.select("gid", "member").unionByName(second.select("gid", "member"))
               .distinct().join(ordinals, "member"))
    hubs = rows.groupBy("gid").agg(F.min("v").alias("lo"), F.count("*").alias("n"))
    star = attach(rows, hubs, "gid", "n", hot_rows).select(F.col("v").alias("hi"), "lo")
    roots = component_roots(star, hot_rows)
    members = ordinals.join(roots, "v")
    runs = segments(
        members, [F.col("root"), F.col("v")], lambda p, t: p["root"] == t["root"], F.col("root")
    ).withColumnRenamed("head", "component")
    if max_group is None:
        return runs.select("component", F.lit(0).cast("bigint").alias("slice"), "pos", "member")
    return _slices(runs, max_group, "component", "member").select(
        "component", "slice", "pos", "member"
    )


def keyed_groups(merged: DataFrame) -> DataFrame:
    """``(burst_id, member)`` with the content-addressed key of each slice.

    Slices hold at most ``max_group`` members, so the collected arrays are bounded.
    """
    members = merged.groupBy("component", "slice").agg(F.collect_list("member").alias("members"))
    return members.select(group_key(F.col("members")).alias("burst_id"), F.explode("members")
                          .alias("member"))


def assign_groups(assets: DataFrame, groups: DataFrame) -> DataFrame:
    """Replace every asset's group id by the one in ``(burst_id, member)``."""
    stamped = groups.select(F.col("member").alias("id"), "burst_id")
    columns = assets.columns if "burst_id" in assets.columns else [*assets.columns, "burst_id"]
    return assets.drop("burst_id").join(stamped, "id", "left").select(*columns)


def group_members(assets: DataFrame) -> DataFrame:
    """``(burst_id, member_ids)`` with members by capture time, then id.

    Group ids are stamped on slices of bounded size, see :func:`split_groups`.
    """
    frames = F.array_sort(F.collect_list(F.struct("taken_at", "id")))
    return (
        assets.filter(F.col("burst_id").isNotNull())
        .groupBy("burst_id").agg(frames.alias("m"))
        .select("burst_id", F.transform("m", lambda f: f["id"]).alias("member_ids"))
    )


def regroup(
    assets: DataFrame,
    dups: DataFrame,
    gap_seconds: float = 10.0,
    max_distance: int | None = 26,
    max_group: int = 10,
) -> DataFrame:
    """Derive all groups anew over the whole asset table and stamp them."""
    bursts = cut(burst_groups(assets, gap_seconds, max_distance, max_group))
    merged = merge_groups(bursts, known_duplicates(dups, assets), max_group)
    return assign_groups(assets, keyed_groups(merged))
