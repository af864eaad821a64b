"""Comparison design and outcomes: best-worst sets, pairs, tallies, Swiss rounds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickline.operators.ordering import BLOCK_ROWS, carried_scan, with_position
from pickline.operators.skew import attach
from pickline.schemas import TIE
from pickline.session import cut

#: History reaching back further than this many places is checked after pairing, not before.
NEAR_PLACES = 256


def build_sets(
    ids: DataFrame, set_size: int = 8, appearances: int = 4, seed: int = 0, key: str = "asset_id"
) -> DataFrame:
    """Best-worst sets over distinct ids: ``(set_id, round, member, place)``.

    In every round all ids are shuffled by a seeded hash and cut into sets whose sizes differ by
    at most one, so each id appears once per round. Up to ``set_size`` ids form one set per round;
    a single id forms none.
    """
    rounds, size = max(1, appearances), max(2, set_size)
    unique = ids.select(key).distinct()
    # rounds are a small option, so this repeats each id a fixed number of times
    drawn = unique.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn(
        "draw", F.xxhash64(F.col(key), "round", F.lit(seed))
    )
    placed = cut(with_position(drawn, F.col("round"), F.col("draw"), F.col(key)).drop("draw"))
    n = placed.filter("round = 1").count()
    if n < 2:
        n_sets = 0
    else:
        n_sets = min(max(1, -(-n // size)), max(1, n // 2))
    if n_sets == 0:
        return placed.filter(F.lit(False)).select(
            F.col("position").alias("set_id"), "round", F.col(key).alias("member"),
            F.col("position").alias("place"),
        )
    base, extra = divmod(n, n_sets)
    # the first `extra` sets of a round hold base + 1 ids, the others base
    at = F.col("position") % n
    wide = extra * (base + 1)
    index = F.when(at < wide, F.floor(at / (base + 1))).otherwise(
        extra + F.floor((at - wide) / base)
    )
    place = F.when(at < wide, at % (base + 1)).otherwise((at - wide) % base)
    return placed.select(
        ((F.col("round") - 1) * n_sets + index).cast("bigint").alias("set_id"),
        "round", F.col(key).alias("member"), place.cast("bigint").alias("place"),
    )


def set_rows(sets: DataFrame) -> DataFrame:
    """Sets in long form as one row each with ``member_ids``; sets are at most ``set_size`` long."""
    members = F.array_sort(F.collect_list(F.struct("place", "member")))
    return sets.groupBy("set_id", "round").agg(members.alias("m")).select(
        "set_id", "round", F.transform("m", lambda x: x["member"]).alias("member_ids")
    )


def set_rounds(sets: DataFrame, n_sets: int, appearances: int, index: str = "set_id") -> DataFrame:
    """Label the ``index``-th of ``n_sets`` planned sets with its round, starting at 1."""
    per_round = max(1, n_sets // max(1, appearances))
    return sets.withColumn("round", (F.floor(F.col(index) / per_round) + 1).cast("int"))


def expand_sets(sets: DataFrame) -> DataFrame:
    """Outcomes implied by judged sets ``(member_ids, best_id, worst_id)`` as ``(a, b, winner)``.

    The best beats every other member and every other member beats the worst, best against worst
    counting once. Sets with repeats, fewer than two members or impossible picks are left out.
    """
    members, best, worst = F.col("member_ids"), F.col("best_id"), F.col("worst_id")
    sound = (
        (F.size(members) >= 2)
        & (F.size(F.array_distinct(members)) == F.size(members))
        & F.array_contains(members, best)
        & F.array_contains(members, worst)
        & (best != worst)
    )
    rows = sets.filter(sound).select(best, worst, F.explode(members).alias("member"))
    return _implied(rows)


def expand_members(members: DataFrame, picks: DataFrame) -> DataFrame:
    """:func:`expand_sets` for sets in long form, whatever their size.

    ``members`` is ``(set_id, member)`` without repeats, ``picks`` ``(set_id, best_id, worst_id,
    n)`` with ``n`` members per set.
    """
    sound = picks.filter((F.col("n") >= 2) & (F.col("best_id") != F.col("worst_id")))
    return _implied(attach(members.select("set_id", "member"), sound, "set_id", "n"))


def _implied(rows: DataFrame) -> DataFrame:
    best, worst, member = F.col("best_id"), F.col("worst_id"), F.col("member")
    beaten = F.when(member != best, F.struct(best.alias("a"), member.alias("b"),
                                             best.alias("winner")))
    beats = F.when((member != best) & (member != worst),
                   F.struct(member.alias("a"), worst.alias("b"), member.alias("winner")))
    return rows.select(F.explode(F.array_compact(F.array(beaten, beats))).alias("p")).select("p.*")


def collect_pairs(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every outcome on record: expanded sets and head-to-heads; blank or self pairs are skipped."""
    recorded = pairs.filter(
        (F.coalesce("a_id", F.lit("")) != "") & (F.coalesce("b_id", F.lit("")) != "")
        & (F.coalesce("winner", F.lit("")) != "") & (F.col("a_id") != F.col("b_id"))
    )
    return expand_sets(sets).unionByName(
        recorded.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "winner")
    )


def split_outcomes(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable outcomes, and self pairs or foreign winners with an ``error``."""
    error = (
        F.when(F.col("a") == F.col("b"), "an item cannot be compared with itself")
        .when(~F.coalesce(F.col("winner").isin(TIE) | (F.col("winner") == F.col("a"))
                          | (F.col("winner") == F.col("b")), F.lit(False)),
              "winner is neither side")
    )
    rows = pairs.withColumn("error", error)
    return rows.filter("error is null").drop("error"), rows.filter("error is not null")


def outcomes_by_pair(pairs: DataFrame) -> DataFrame:
    """``(i, j, n, wins_i, wins_j)`` per unordered pair; a tie is half a win for both.

    Counts combine map-side, so a pair or an item in a third of all outcomes costs one partial
    row per task.
    """
    def won(side: str):
        tied = F.col("winner") == TIE
        return F.sum(F.when(tied, 0.5).when(F.col("winner") == F.col(side), 1.0).otherwise(0.0))

    return pairs.select(
        F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "winner"
    ).groupBy("i", "j").agg(
        F.count("*").cast("double").alias("n"), won("i").alias("wins_i"), won("j").alias("wins_j")
    )


def item_totals(by_pair: DataFrame) -> DataFrame:
    """``(item, wins, degree)`` from the outcomes per pair."""
    sides = F.array(
        F.struct(F.col("i").alias("item"), F.col("wins_i").alias("w")),
        F.struct(F.col("j").alias("item"), F.col("wins_j").alias("w")),
    )
    return by_pair.select(F.explode(sides).alias("s")).groupBy(F.col("s.item").alias("item")).agg(
        F.sum("s.w").alias("wins"), F.count("*").alias("degree")
    )


def tally(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``items (item, wins)``, ``versus (i, j, n)`` with each unordered pair once, error rows."""
    good, bad = split_outcomes(pairs)
    by_pair = outcomes_by_pair(good)
    return item_totals(by_pair).drop("degree"), by_pair.select("i", "j", "n"), bad


def symmetric(versus: DataFrame) -> DataFrame:
    """Comparison counts in both directions."""
    return versus.unionByName(versus.select(F.col("j").alias("i"), F.col("i").alias("j"), "n"))


def pair_history(pairs: DataFrame, stage: str = "finals") -> DataFrame:
    """Unordered pairs already played in a stage."""
    real = (F.coalesce("a_id", F.lit("")) != "") & (F.coalesce("b_id", F.lit("")) != "") & (
        F.col("a_id") != F.col("b_id")
    )
    return pairs.filter((F.col("stage") == stage) & real).select(
        F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")
    ).distinct()


def _pair_block(block: pd.DataFrame, carry: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Pair one block: each arriving place is taken by the first waiting place it has not met.

    Serving arrivals in order gives the same pairs as letting every place, from the top, pick its
    nearest free opponent: both prefer the highest upper and then the highest lower place.
    """
    waiting = sorted(carry["place"].tolist())
    pairs = []
    block = block.sort_values("position")
    for place, met in zip(block["position"].tolist(), block["met"].tolist(), strict=True):
        met = () if met is None else set(met)
        taker = next((w for w in waiting if w not in met), None)
        if taker is None:
            waiting.append(place)
        else:
            waiting.remove(taker)
            pairs.append((taker, place))
    return (
        pd.DataFrame(pairs, columns=["upper", "lower"]),
        pd.DataFrame({"place": waiting}),
    )


def _past_met_blocks(met: DataFrame, places: int, block_rows: int):
    """Where waiting places go: the next block in which someone is left whom they haven't met.

    Only places that met whole blocks have a list of these, no longer than there are blocks.
    """
    last = (places - 1) // block_rows
    block = F.floor(F.col("lower") / block_rows).cast("bigint")
    rows = F.when(F.col("met_block") == last, places - last * block_rows).otherwise(block_rows)
    full = cut(
        met.groupBy("upper", block.alias("met_block")).agg(F.count("*").alias("n")).filter(F.col("n") == rows)
        .groupBy(F.col("upper").alias("place")).agg(F.collect_set("met_block").alias("full"))
    )

    def onward(handed: DataFrame) -> DataFrame:
        ahead = F.sequence(F.col("block") + 1, F.lit(last + 1).cast("bigint"))
        target = F.when(F.col("full").isNull(), F.col("block") + 1).otherwise(
            F.element_at(F.array_except(ahead, "full"), 1))
        return handed.join(full, F.col("c.place") == F.col("place"), "left").select(target.alias("block"), "c")

    return onward


def swiss_pairs(
    scores: DataFrame,
    history: DataFrame,
    seed: int | None = None,
    block_rows: int = BLOCK_ROWS,
    near: int = NEAR_PLACES,
) -> DataFrame:
    """One Swiss round over ``(item, score)``: ``(a, b, place)``, never a pair of ``history``.

    From the top, each item takes the nearest lower item that is free and not in ``history``
    ``(a, b)``; who finds none sits out. Ties go by id, or by a seeded hash.

    The result is exact at any size. Places are scanned in parallel blocks, see
    :func:`carried_scan`; who has met all of a block is led past it. A block gets the history among
    places at most ``near`` apart, which is bounded. Pairs that turn out to be in the rest of the
    history show whose history matters: it is added up to twice as far as the pair reached, and the
    scan repeats, so that a place that met everyone needs a logarithmic number of scans. A scan under
    fewer constraints whose pairs break none of the others is the scan under all of them, because its
    every choice was the first one allowed.
    """
    tie = F.col("item") if seed is None else F.xxhash64("item", F.lit(seed))
    placed = cut(with_position(
        scores.select("item", "score"), F.col("score").desc(), tie, F.col("item")
    ))
    at = placed.select("item", "position")
    met = cut(
        history.select("a", "b").distinct()
        .join(at.select(F.col("item").alias("a"), F.col("position").alias("pa")), "a")
        .join(at.select(F.col("item").alias("b"), F.col("position").alias("pb")), "b")
        .filter("pa <> pb")
        .select(F.least("pa", "pb").alias("upper"), F.greatest("pa", "pb").alias("lower"))
        .distinct()
    )
    onward = _past_met_blocks(met, placed.count(), block_rows)
    distance = F.col("lower") - F.col("upper")
    known = met.filter(distance <= near)
    while True:
        per_place = known.groupBy(F.col("lower").alias("position")).agg(
            F.collect_list("upper").alias("met")
        )
        rows = cut(placed.select("position").join(per_place, "position", "left").withColumn(
            "block", F.floor(F.col("position") / block_rows).cast("bigint")
        ))
        pairs = carried_scan(rows, _pair_block, "upper bigint, lower bigint", "place bigint", onward)
        reached = cut(
            pairs.join(met, ["upper", "lower"], "left_semi")
            .groupBy("upper").agg(F.max(distance).alias("reach"))
        )
        if reached.isEmpty():
            break
        more = met.join(reached, "upper").filter(distance <= 2 * F.col("reach")).select("upper", "lower")
        known = cut(known.unionByName(more).distinct())
    return (
        pairs.join(at.select(F.col("position").alias("upper"), F.col("item").alias("a")), "upper")
        .join(at.select(F.col("position").alias("lower"), F.col("item").alias("b")), "lower")
        .select("a", "b", F.col("upper").alias("place"))
    )


def reconcile_orders(forward: DataFrame, reverse: DataFrame, key: list[str] | None = None):
    """Combine both presentation orders of each pair into ``(a_id, b_id, winner, agreed)``.

    ``forward`` holds ``(a_id, b_id, pick)`` with pick ``A``, ``B`` or ``tie``; ``reverse`` the
    same pairs with the sides swapped. Only a pick that survives the swap wins. ``key`` names
    further columns that tell repeated pairs apart.
    """
    key = key or []

    def chosen(df: DataFrame, name: str) -> DataFrame:
        picked = F.when(F.col("pick") == "A", F.col("a_id")).when(
            F.col("pick") == "B", F.col("b_id")
        ).when(F.col("pick") == TIE, TIE)
        return df.withColumn(name, picked)

    first = chosen(forward, "first").select(*key, "a_id", "b_id", "first")
    second = chosen(reverse, "second").select(
        *key, F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), "second"
    )
    agreed = F.col("first") == F.col("second")
    return first.join(second, [*key, "a_id", "b_id"]).select(
        *key, "a_id", "b_id", F.when(agreed, F.col("first")).otherwise(TIE).alias("winner"),
        agreed.alias("agreed"),
    )


