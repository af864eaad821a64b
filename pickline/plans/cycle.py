"""One full curation cycle: group, judge, rank, play finals, star, plan."""

from __future__ import annotations

from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickline.operators import actions, bands, compare, groups, merges, strength, worklists
from pickline.operators.judging import Judge, apply_singles, judge_with
from pickline.schemas import BWS_SETS, PAIRS, Options, align
from pickline.session import cut

Tables = dict[str, DataFrame]


def _settled(tables: Tables, *names: str) -> Tables:
    """The named tables written, so that later stages start from them."""
    return {**tables, **{n: cut(tables[n]) for n in names}}


def _next_id(table: DataFrame) -> int:
    return (table.agg(F.max("id")).first()[0] or 0) + 1


class Counters:
    """What each judging stage asked, got and paid, one row per stage; finals rounds are stages too."""

    def __init__(self):
        self.rows: list[DataFrame] = []

    def add(self, stage: str, verdicts: DataFrame) -> DataFrame:
        """Note the verdicts of a stage and hand them on."""
        failed = F.col("error").isNotNull()
        self.rows.append(verdicts.agg(
            F.lit(stage).alias("stage"), F.count("*").alias("asked"), F.count_if(~failed).alias("judged"),
            F.count_if(failed).alias("errors"),
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")]))
        return verdicts

    def table(self) -> DataFrame | None:
        """``(stage, asked, judged, errors, input_tokens, output_tokens)`` of the stages that ran."""
        return reduce(DataFrame.unionByName, self.rows) if self.rows else None


def group_stage(tables: Tables, dups: DataFrame, options: Options) -> Tables:
    """Stamp groups anew over all assets."""
    assets = groups.regroup(
        tables["assets"], dups, options.burst_gap_seconds, options.dhash_max_distance,
        options.burst_max_group,
    )
    return _settled({**tables, "assets": assets}, "assets")


def triage_stage(
    tables: Tables, judges: dict[str, Judge], now: Column, counters: Counters | None = None
) -> Tables:
    """Judge pending groups, then pending single assets, which include the groups' survivors."""
    todo = cut(worklists.members_of(
        worklists.pending_bursts(tables["assets"], tables["bursts"], tables["batch_items"],
                                 tables["batches"]), tables["assets"]))
    counters = counters or Counters()
    verdicts = counters.add("burst", judge_with(todo, judges["burst"], "burst", count=F.size("member_ids")))
    good = verdicts.filter("error is null")
    bursts, decisions, _ = merges.resolve_bursts(
        todo, good.select("burst_id", "best_index", "reject_indices", "note"),
        tables["bursts"], tables["decisions"], now,
    )
    # survivors are only known once the group verdicts are on record
    tables = _settled({**tables, "bursts": bursts, "decisions": decisions}, "bursts", "decisions")
    singles = worklists.pending_singles(
        tables["assets"], tables["triage"], tables["bursts"], tables["batch_items"],
        tables["batches"],
    )
    items = cut(tables["assets"].join(singles, "id", "left_semi").select("id", "filename", "camera"))
    verdicts = counters.add("triage", judge_with(items, judges["triage"], "triage")).filter("error is null")
    rows = verdicts.withColumnRenamed("id", "asset_id").withColumnRenamed("reply", "raw")
    triage, decisions = apply_singles(tables["triage"], tables["decisions"], rows, now)
    return _settled({**tables, "triage": triage, "decisions": decisions}, "triage", "decisions")


def refit(tables: Tables, options: Options, now: Column) -> tuple[Tables, DataFrame]:
    """Fit strengths over every outcome on record and store them with their ranks."""
    pairs = compare.collect_pairs(tables["bws_sets"], tables["pairs"])
    ranked = cut(strength.rank_scores(strength.bradley_terry(
        pairs, options.fit_iterations, options.fit_tol)))
    scores = strength.merge_scores(tables["scores"], ranked, now)
    return _settled({**tables, "scores": scores}, "scores"), ranked


def rank_stage(
    tables: Tables, judges: dict[str, Judge], options: Options, now: Column,
    counters: Counters | None = None,
) -> Tables:
    """Judge the best-worst sets that have no judgment yet, then fit."""
    cands = worklists.candidates(tables["triage"], tables["decisions"],
                                 options.candidate_score_min)
    pool = bands.cap_candidates(cands, tables["scores"], options.scoring_limit)
    sets = compare.build_sets(pool, options.bws_set_size, options.bws_appearances, options.seed)
    planned = cut(compare.set_rows(sets))
    todo = cut(worklists.unplanned_sets(planned, tables["bws_sets"]))
    verdicts = judge_with(todo, judges["bws"], "bws", count=F.size("member_ids"))
    recorded = (counters or Counters()).add("bws", verdicts).filter("error is null").select(
        (F.col("set_id") + _next_id(tables["bws_sets"])).alias("id"), "round", "member_ids",
        F.get("member_ids", F.col("best_index") - 1).alias("best_id"),
        F.get("member_ids", F.col("worst_index") - 1).alias("worst_id"),
        now.alias("judged_at"),
    )
    tables = _settled({**tables, "bws_sets": tables["bws_sets"].unionByName(
        align(recorded, BWS_SETS))}, "bws_sets")
    return refit(tables, options, now)[0]


def judge_pairs(
    pairings: DataFrame, judge: Judge, counters: Counters | None = None, stage: str = "finals"
) -> DataFrame:
    """Judge each pairing in both orders: ``(a_id, b_id, winner, agreed)``."""
    shown = pairings.select(F.col("a").alias("a_id"), F.col("b").alias("b_id"))
    both = shown.withColumn("turned", F.lit(False)).unionByName(shown.select(
        F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), F.lit(True).alias("turned")))
    verdicts = (counters or Counters()).add(stage, judge_with(both, judge, "pair"))
    good = verdicts.filter("error is null").withColumnRenamed("winner", "pick")
    return compare.reconcile_orders(good.filter("not turned"), good.filter("turned"))


def finals_stage(
    tables: Tables, judges: dict[str, Judge], options: Options, now: Column,
    counters: Counters | None = None,
) -> Tables:
    """Swiss rounds over the top pool, then star bands over the whole ranking.

    With no outcome on record there is no ranking, and the bands are cut from the pool's order.
    """
    scored = tables["scores"].filter("bt_score is not null")
    n_scored = scored.count()
    five = bands.five_target(scored, options.five_star_fraction, options.five_count)
    pool = cut(bands.top_pool(tables["scores"], five, options.finals_pool_size))
    if pool.count() < 2:
        return tables
    standing = pool.select(F.col("asset_id").alias("item"), F.col("bt_score").alias("score"))
    ranked = None
    for turn in range(options.finals_rounds):
        history = compare.pair_history(tables["pairs"])
        pairings = cut(compare.swiss_pairs(standing, history))
        if pairings.isEmpty():
            break
        outcome = judge_pairs(pairings, judges["pair"], counters, f"finals {turn + 1}")
        base = _next_id(tables["pairs"])
        place = pairings.select(F.col("a").alias("a_id"), "place")
        recorded = outcome.join(place, "a_id").select(
            (F.col("place") + base).alias("id"), "a_id", "b_id", "winner",
            F.lit("finals").alias("stage"), now.alias("judged_at"),
        )
        tables = _settled({**tables, "pairs": tables["pairs"].unionByName(
            align(recorded, PAIRS))}, "pairs")
        tables, ranked = refit(tables, options, now)
        standing = cut(standing.join(
            ranked.select("item", "strength"), "item", "left"
        ).select("item", F.coalesce("strength", "score").alias("score")))
    if ranked is None:
        tables, ranked = refit(tables, options, now)
    if ranked.isEmpty():
        ranked = pool.select(F.col("asset_id").alias("item"), F.col("bt_score").alias("strength"))
    return star_stage(tables, ranked, five, n_scored, options, now)


def star_stage(
    tables: Tables, ranked: DataFrame, five: int, n_scored: int, options: Options, now: Column
) -> Tables:
    """Cut bands from the ranking, keep sticky fives, and record stars and decisions."""
    order = ranked.select(F.col("item").alias("asset_id"), F.col("strength").alias("bt_score"))
    if options.four_frac is not None:
        rows = bands.star_bands(order, five, options.four_frac, options.full_star_spectrum)
    else:
        rows = bands.fraction_bands(
            order, options.five_star_fraction, options.four_star_fraction,
            options.full_star_spectrum, n_scored, five,
        )
    fives = None
    if not options.allow_demotions:
        prior = bands.prior_fives(tables["scores"], tables["decisions"])
        external = bands.external_fives(tables["assets"], prior)
        rows = bands.protect_fives(rows, prior, external)
        fives = prior.unionByName(external)
    rows = cut(rows)
    scores, decisions = bands.retract_stars(tables["scores"], tables["decisions"], rows)
    starred = rows.filter("stars is not null").select("asset_id", "stars")
    made = bands.band_decisions(rows, now)
    if options.full_star_spectrum:
        tail = cut(bands.star_tail(tables["triage"], decisions, rows, exempt=fives))
        starred = starred.unionByName(tail.select("asset_id", "stars"))
        made = made.unionByName(bands.tail_decisions(tail, now))
    return _settled({
        **tables,
        "scores": merges.merge_upsert(scores, starred, "asset_id"),
        "decisions": merges.merge_decisions(decisions, made),
    }, "scores", "decisions")


def run_cycle(
    tables: Tables,
    judges: dict[str, Judge],
    options: Options | None = None,
    dups: DataFrame | None = None,
    now: datetime | None = None,
    counters: Counters | None = None,
) -> tuple[Tables, DataFrame]:
    """All stages in order; returns the next tables and the plan of actions.

    ``counters``, where given, collects what the judging stages asked, got and paid.

    ``judges`` maps ``burst``, ``triage``, ``bws`` and ``pair`` to functions of one row, see
    :func:`judge_with`: a group or set row has ``member_ids``, a pair row ``a_id`` and ``b_id``.
    Work on record is skipped, so a second run judges only what is new.
    """
    o = options or Options()
    at = F.lit(now or datetime.now(UTC))
    if dups is None:
        dups = tables["assets"].sparkSession.createDataFrame([], "group_id string, member string")
    tables = group_stage(tables, dups, o)
    counters = counters or Counters()
    tables = triage_stage(tables, judges, at, counters)
    tables = rank_stage(tables, judges, o, at, counters)
    tables = finals_stage(tables, judges, o, at, counters)
    return tables, actions.plan(tables, o)


