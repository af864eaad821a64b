"""Every operator as a query over a directory of parquet tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pickline.functions import replies as R
from pickline.functions import scalars as S
from pickline.operators import (
    actions, bands, compare, groups, judging, merges, packing, report, strength, worklists,
)
from pickline.plans import cycle
from pickline.plans import views as V
from pickline.schemas import ASSETS, DECISIONS, Options, align, empty_tables
from pickline.session import checkpoint_dir, cut
from pickline.sources import assets as sources
from pickline.sources import images
from pickline.sources.tables import save_tables
from pickline.sources.tables import write_actions as write_plan
from pickline.streaming import bursts as stream_ops
from pickline.streaming import watch as watching

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def micros(name: str):
    return F.unix_micros(F.col(name).cast("timestamp")).alias(name)


def joined(name: str, sep: str = ","):
    return F.array_join(name, sep).alias(name)


# --- sources ---------------------------------------------------------------------------------

def _documents(spark, d):
    """Events as nested asset documents."""
    e = V.table(spark, d, "events")
    even = F.col("event_id") % 2 == 0
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return e.select(
        F.when(F.col("event_type") != "error", V.key("e", "event_id")).alias("id"),
        F.concat(F.lit("IMG_"), F.col("event_id").cast("string")).alias("originalFileName"),
        F.when(F.col("event_type") == "view", "VIDEO")
        .when(F.col("event_type") == "click", "IMAGE").alias("type"),
        F.lit("junk").alias("localDateTime"),
        text.alias("fileCreatedAt"),
        F.lit(2).alias("rating"),
        F.struct(
            F.when(even, F.concat(F.lit(" maker"), F.col("user_id") % 5)).alias("make"),
            F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("m"), F.col("user_id"))
                   ).alias("model"),
            F.lit(400).alias("exifImageWidth"), F.lit(300).alias("exifImageHeight"),
            F.when(even, "not a date").alias("dateTimeOriginal"),
            F.when(even, 4).alias("rating"),
            F.when(even, "").otherwise("text").alias("description"),
        ).alias("exifInfo"),
        F.col("event_id").alias("dhash"), F.lit(None).cast("string").alias("thumb_path"),
    )


def _scratch(spark, what):
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _asset_columns():
    return ["id", "filename", micros("taken_at"), "camera", "description", "width", "height", "source_rating", "dhash"]


@query
def read_assets(spark, d):
    return sources.flatten_assets(_documents(spark, d)).select(*_asset_columns())


@query
def read_assets_window(spark, d):
    path = _scratch(spark, "documents")
    sources.write_documents(_documents(spark, d), path)
    return sources.read_assets(spark, path, after="2024-01-10", before="2024-01-20").select(*_asset_columns())


@query
def hash_images(spark, d):
    path = _scratch(spark, "images")
    V.write_images(spark, d, path)
    found = images.hash_images(spark, path)
    return found.select(F.regexp_extract("path", r"vec_id=(\d+)", 1).cast("bigint").alias("vec_id"), "dhash")


@query
def time_window(spark, d):
    rows = sources.time_window(V.table(spark, d, "events"), "ts", "2024-01-10", "2024-01-20")
    return rows.select("event_id", "user_id", micros("ts"))


@query
def lookup(spark, d):
    ids = V.table(spark, d, "labels").select(V.key("e", "doc_id").alias("id"))
    return sources.lookup(V.assets(spark, d), ids).select("id", "camera", micros("taken_at"))


# --- scalar functions ------------------------------------------------------------------------

@query
def capture_time(spark, d):
    o = V.table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    n = F.col("o_orderkey")
    first = F.when(n % 5 == 0, day).when(n % 5 == 1, F.concat(day, F.lit("T10:11:12.500Z"))).when(
        n % 5 == 2, F.concat(day, F.lit("T10:11:12+02:00"))).when(
        n % 5 == 3, "yesterday")
    second = F.when(n % 2 == 0, F.concat(day, F.lit(" 01:02:03")))
    return o.select("o_orderkey", F.unix_micros(S.capture_time(first, second)).alias("taken_at"))


@query
def camera_key(spark, d):
    p = V.table(spark, d, "part")
    make = F.when(F.col("p_size") % 4 > 0, F.concat(F.lit("  "), "p_brand"))
    model = F.when(F.col("p_size") % 4 > 1, F.concat("p_type", F.lit(" "))).otherwise(" ")
    return p.select("p_partkey", S.camera_key(make, model).alias("camera"))


@query
def iso_bound(spark, d):
    o = V.table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(day, F.lit("T05:00:00Z"))).otherwise(
        F.concat(F.lit(" "), day))
    return o.select("o_orderkey", S.iso_bound(text).alias("bound"),
                    S.iso_bound(F.col("o_orderdate"), True).alias("moment"))


@query
def interval_seconds(spark, d):
    e = V.table(spark, d, "events")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("s", "m", "H", "d", "w", "", " x")]),
                        (F.col("event_id") % 7 + 1).cast("int"))
    text = F.concat((F.col("user_id") % 40 - 2).cast("string"), unit)
    return e.select("event_id", S.interval_seconds(text).alias("seconds"))


@query
def dhash_bits(spark, d):
    return V.hashes(spark, d)


@query
def hamming(spark, d):
    h = V.hashes(spark, d)
    nxt = h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("dhash").alias("other"))
    return h.join(nxt, "vec_id").select(
        "vec_id", S.hamming(F.col("dhash"), F.col("other")).alias("distance"))


@query
def normalize_keywords(spark, d):
    words = S.normalize_keywords(F.split("text", " "))
    return V.table(spark, d, "documents").select(
        "doc_id", F.array_join(words, "|").alias("keywords"))


@query
def group_key(spark, d):
    # keys do not depend on the order of the members
    n = groups.group_members(V.grouped_assets(spark, d))
    return n.select("burst_id", S.group_key(F.col("member_ids")).alias("group_key"),
                    S.group_key(F.reverse("member_ids")).alias("reversed_key"))


@query
def triage_bucket(spark, d):
    return V.verdicts(spark, d).select("asset_id", S.triage_bucket(
        F.col("category"), F.col("verdict"), F.col("confidence")).alias("bucket"))


@query
def work_ids(spark, d):
    c = V.table(spark, d, "customer")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("triage", "burst", "bws", "pair", "zip")]),
                        (F.col("c_custkey") % 5 + 1).cast("int"))
    text = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("a:"), "c_name")).otherwise(
        F.regexp_replace("c_name", "[^a-zA-Z0-9_-]", "-"))
    rows = c.select("c_custkey", kind.alias("k"), text.alias("t")).withColumn(
        "custom_id", S.make_work_id(F.col("k"), F.col("t")))
    return rows.select(
        "c_custkey", "custom_id",
        S.work_kind(F.col("custom_id"), F.lit("triage")).alias("kind"),
        S.work_key(F.col("custom_id")).alias("work_key"))


@query
def decode_detail(spark, d):
    e = V.table(spark, d, "events")
    text = F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise(F.col("props"))
    return e.select("event_id", S.decode_detail(text).alias("v")).select(
        "event_id", F.try_variant_get("v", "$.k", "int").alias("k"),
        F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string"))
        .alias("raw"))


@query
def parse_replies(spark, d):
    rows = R.checked(R.parse_replies(V.replies(spark, d).filter("error is null"), "triage"),
                     "triage")
    return rows.select("custom_id", "category", "verdict", "technical_score", "confidence",
                       "caption", joined("keywords"), joined("reasons"),
                       F.col("error").isNull().alias("usable"))


@query
def validate_verdicts(spark, d):
    rows = V.verdicts(spark, d)
    wide = rows.withColumn("technical_score", F.col("technical_score") + F.when(
        F.col("confidence") == "low", 2).otherwise(0)).withColumn(
        "verdict", F.when(F.col("reasons")[1] == "doc 8", "maybe").otherwise(F.col("verdict")))
    valid, rejected = R.validate_verdicts(wide, "triage")
    return valid.select("asset_id", F.lit(None).cast("string").alias("error")).unionByName(
        rejected.select("asset_id", "error"))


@query
def validate_set_picks(spark, d):
    o = V.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_quantity") % 9).cast("int").alias("best_index"),
        (F.col("l_suppkey") % 9).cast("int").alias("worst_index"),
        F.lit("n").alias("note"))
    valid, rejected = R.validate_verdicts(o, "bws", F.lit(7))
    return valid.withColumn("error", F.lit("")).unionByName(rejected).groupBy("error").agg(
        F.count("*").alias("n"))


@query
def validate_burst_picks(spark, d):
    o = V.table(spark, d, "lineitem").select(
        "l_orderkey",
        (F.col("l_quantity") % 6).cast("int").alias("best_index"),
        F.array((F.col("l_suppkey") % 6).cast("int"), F.lit(2)).alias("reject_indices"))
    strict = R.checked(o, "burst", F.lit(4), True).select(F.lit("strict").alias("mode"), "error")
    loose = R.checked(o, "burst", F.lit(4), False).select(F.lit("loose").alias("mode"), "error")
    return strict.unionByName(loose).groupBy("mode", "error").agg(F.count("*").alias("n"))


@query
def report_captions(spark, d):
    return report.report_captions(
        V.rated_parts(spark, d), V.triage(spark, d, "p"),
        V.scores(spark, d).withColumn("rank", F.col("stars").cast("bigint")),
        V.part_decisions(spark, d))


# --- joins and work lists --------------------------------------------------------------------

@query
def unjudged(spark, d):
    a = V.grouped_assets(spark, d)
    return worklists.unjudged(a, V.triage(spark, d)).select("id")


@query
def unjudged_with_groups(spark, d):
    a = align(V.assets(spark, d), ASSETS)
    return worklists.unjudged(a, V.triage(spark, d), exclude_bursts=False).select("id")


@query
def unjudged_bursts(spark, d):
    a = V.grouped_assets(spark, d)
    return worklists.unjudged_bursts(a, V.bursts(a))


@query
def inflight(spark, d):
    return worklists.inflight(V.batch_items(spark, d), V.batches(spark, d))


def _queued_bursts(a: DataFrame, spark, d) -> DataFrame:
    """Items of the batches, and groups whose key ends in 0 as queued work of b2."""
    extra = a.filter("burst_id is not null and burst_id like '%0'").select(
        F.concat(F.lit("burst_"), "burst_id").alias("custom_id")).distinct().select(
        "custom_id", F.lit("b2").alias("batch_id"))
    return V.batch_items(spark, d).select("custom_id", "batch_id").unionByName(extra)


@query
def pending_bursts(spark, d):
    a = V.grouped_assets(spark, d)
    return worklists.pending_bursts(a, V.bursts(a), _queued_bursts(a, spark, d),
                                    V.batches(spark, d))


@query
def pending_singles(spark, d):
    a = V.grouped_assets(spark, d)
    return worklists.pending_singles(a, V.triage(spark, d), V.bursts(a),
                                     _queued_bursts(a, spark, d), V.batches(spark, d))


@query
def work_queue(spark, d):
    a = V.grouped_assets(spark, d)
    items, batches, b = _queued_bursts(a, spark, d), V.batches(spark, d), V.bursts(a)
    return worklists.work_queue(
        worklists.pending_bursts(a, b, items, batches),
        worklists.pending_singles(a, V.triage(spark, d), b, items, batches), a, 500)


@query
def candidates(spark, d):
    return worklists.candidates(V.triage(spark, d), V.decisions(spark, d)).select(
        "asset_id", "technical_score")


@query
def unenriched(spark, d):
    a = align(V.assets(spark, d), ASSETS)
    return worklists.unenriched(V.triage(spark, d), a).select(
        "asset_id", "caption", joined("keywords"), "description")


@query
def rejudge_targets(spark, d):
    a = align(V.assets(spark, d), ASSETS)
    return worklists.rejudge_targets(
        a, V.triage(spark, d), V.decisions(spark, d), after="2024-01-01T06:00:00",
        before="2024-01-02", bucket="middle", missing_captions=True)


@query
def forget_triage(spark, d):
    a = V.grouped_assets(spark, d)
    targets = V.decisions(spark, d).filter("bucket = 'reject'").select("asset_id")
    t, b = worklists.forget_triage(V.triage(spark, d), V.bursts(a), a, targets)
    return t.select(F.lit("triage").alias("t"), F.col("asset_id").alias("k")).unionByName(
        b.select(F.lit("bursts").alias("t"), F.col("burst_id").alias("k")))


@query
def forget_rank(spark, d):
    sets, pairs, sc = worklists.forget_rank(
        V.bws_sets(spark, d), V.duel_pairs(spark, d), V.scores(spark, d))
    counts = sets.agg(F.count("*").alias("n_sets")).unionByName(
        pairs.agg(F.count("*").alias("n_pairs")), allowMissingColumns=True).unionByName(
        sc.agg(F.count("bt_score").alias("n_scored"), F.count("stars").alias("n_starred")),
        allowMissingColumns=True)
    return counts.agg(*[F.sum(c).alias(c) for c in counts.columns])


@query
def forget_finals(spark, d):
    return worklists.forget_finals(V.duel_pairs(spark, d)).groupBy("stage").agg(
        F.count("*").alias("n"))


@query
def known_duplicates(spark, d):
    # events of the first documents are the known assets
    known = V.table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return groups.known_duplicates(V.dup_groups(spark, d), known).select("group_id", "member")


@query
def unplanned_sets(spark, d):
    # every set is planned twice; customers record none to three of the copies
    def members(col: str, half: int):
        return F.array(F.lit("x"), F.floor(F.col(col) / half).cast("string"))

    p = V.table(spark, d, "part").select(
        F.col("p_partkey").alias("set_id"), members("p_partkey", 2).alias("member_ids"))
    j = V.table(spark, d, "customer").select(
        F.reverse(members("c_custkey", 3)).alias("member_ids"))
    return worklists.unplanned_sets(p, j).select("set_id", joined("member_ids"))


@query
def price_join(spark, d):
    rows = report.price_join(V.usage(spark, d), V.prices(spark))
    return rows.groupBy("model", "prefix", "price_in", "price_out").agg(F.count("*").alias("n"))


@query
def decision_filter(spark, d):
    return worklists.decision_filter(V.decisions(spark, d), "middle", True).select(
        "asset_id", "bucket")


# --- grouping --------------------------------------------------------------------------------

@query
def burst_chains(spark, d):
    rows = groups.burst_chains(V.assets(spark, d, True), V.GAP_SECONDS, 26)
    return rows.select("id", "head", "pos", "last")


@query
def burst_chains_by_time(spark, d):
    rows = groups.burst_chains(
        V.assets(spark, d).withColumn("dhash", F.lit(None).cast("bigint")), V.GAP_SECONDS, None)
    return rows.groupBy("head").agg(F.count("*").alias("frames"))


@query
def split_groups(spark, d):
    chains = groups.burst_chains(V.assets(spark, d, True), V.GAP_SECONDS, 26)
    heads = chains.select("segment", F.col("head")).distinct()
    return groups.split_groups(chains, V.MAX_GROUP).join(heads, "segment").select(
        "id", "head", "slice", "pos")


@query
def merge_groups(spark, d):
    rows = groups.merge_groups(V.neighbour_groups(spark, d), V.dup_groups(spark, d).withColumn(
        "ord", F.col("member")), V.MAX_GROUP)
    return rows.select("component", "slice", "pos", "member")


@query
def assign_groups(spark, d):
    return V.grouped_assets(spark, d).select("id", "burst_id")


@query
def group_members(spark, d):
    return groups.group_members(V.grouped_assets(spark, d)).select(
        "burst_id", joined("member_ids"))


def _packed(spark, d) -> DataFrame:
    items = V.table(spark, d, "documents").select(
        V.key("d", "doc_id").alias("custom_id"), F.col("n_chars").alias("bytes"))
    return packing.pack_batches(items, 20, 40_000)


@query
def pack_batches(spark, d):
    return _packed(spark, d)


@query
def pack_batches_caps(spark, d):
    sizes = _packed(spark, d).groupBy("batch_id").agg(
        F.count("*").alias("n"), F.sum("bytes").alias("b"))
    return sizes.agg(
        F.sum("n").alias("items"), F.sum("b").alias("bytes"),
        F.count_if((F.col("n") > 20) | ((F.col("b") > 40_000) & (F.col("n") > 1)))
        .alias("over_cap"))


# --- aggregates ------------------------------------------------------------------------------

@query
def summary(spark, d):
    return report.summary(V.tables(spark, d))


@query
def breakdown(spark, d):
    t = V.triage(spark, d)
    return report.breakdown(t, "verdict").select(
        F.lit("verdict").alias("what"), F.col("verdict").alias("value"), "n").unionByName(
        report.breakdown(t, "category").select(
            F.lit("category").alias("what"), F.col("category").alias("value"), "n"))


@query
def triage_stats(spark, d):
    v = V.verdicts(spark, d)
    singles = v.select(
        S.triage_bucket(F.col("category"), F.col("verdict"), F.col("confidence")).alias("bucket"),
        "verdict", F.length("caption").cast("bigint").alias("input_tokens"),
        F.col("technical_score").cast("bigint").alias("output_tokens"))
    a = V.grouped_assets(spark, d)
    b = V.bursts(a).select("reject_ids", F.lit(7).cast("bigint").alias("input_tokens"),
                           F.lit(2).cast("bigint").alias("output_tokens"))
    return report.triage_stats(singles, b, V.replies(spark, d).filter("error is not null"))


@query
def cost_by_model(spark, d):
    return report.cost_by_model(V.usage(spark, d), V.prices(spark)).withColumn(
        "cost", F.round("cost", 4))


@query
def tally_items(spark, d):
    return compare.tally(compare.expand_members(*V.order_sets(spark, d)))[0]


@query
def tally_versus(spark, d):
    return compare.symmetric(compare.tally(compare.expand_members(*V.order_sets(spark, d)))[1])


@query
def tally_errors(spark, d):
    pairs = V.duel_pairs(spark, d).select(
        F.col("a_id").alias("a"), F.col("b_id").alias("b"),
        F.when(F.col("a_id") > F.col("b_id"), "nobody").otherwise(F.col("winner")).alias("winner"))
    return compare.tally(pairs)[2].groupBy("error").agg(F.count("*").alias("n"))


def _part_plan(spark, d) -> DataFrame:
    return actions.plan(_plan_tables(spark, d), Options(keyword_tags=True, album="Best"))


def _plan_tables(spark, d) -> dict[str, DataFrame]:
    a = V.grouped_assets(spark, d)
    return {
        "assets": align(a, ASSETS),
        "triage": V.triage(spark, d),
        "bursts": V.bursts(a),
        "decisions": V.decisions(spark, d).unionByName(V.part_decisions(spark, d)),
    }


@query
def fold_tags(spark, d):
    return actions.fold_tags(_part_plan(spark, d))


@query
def fold_updates(spark, d):
    return actions.fold_updates(_part_plan(spark, d))


# --- ranking ---------------------------------------------------------------------------------

@query
def build_sets(spark, d):
    sets = compare.build_sets(
        V.scores(spark, d).select("asset_id"), V.SET_SIZE, 4, seed=20240601)
    sizes = sets.groupBy("round", "set_id").agg(
        F.count("*").alias("n"), F.count_distinct("member").alias("m"))
    return sizes.groupBy("round").agg(
        F.count("*").alias("n_sets"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.sum("m").alias("members"))


@query
def build_sets_members(spark, d):
    return compare.build_sets(V.scores(spark, d).select("asset_id"), V.SET_SIZE, 4, seed=20240601)


@query
def build_sets_appearances(spark, d):
    sets = compare.build_sets(V.scores(spark, d).select("asset_id"), V.SET_SIZE, 4, seed=7)
    return sets.groupBy("member").agg(F.count("*").alias("n"),
                                      F.count_distinct("round").alias("rounds"))


@query
def set_rounds(spark, d):
    p = V.table(spark, d, "part").select(F.col("p_partkey").alias("set_id"))
    return compare.set_rounds(p, p.count(), 4)


@query
def expand_sets(spark, d):
    pairs = compare.expand_sets(V.bws_sets(spark, d))
    return pairs.groupBy("a", "b", "winner").agg(F.count("*").alias("n"))


@query
def expand_members(spark, d):
    pairs = compare.expand_members(*V.order_sets(spark, d))
    return pairs.groupBy("a", "b", "winner").agg(F.count("*").alias("n"))


@query
def collect_pairs(spark, d):
    pairs = compare.collect_pairs(V.bws_sets(spark, d), V.duel_pairs(spark, d))
    return pairs.groupBy("winner").agg(F.count("*").alias("n"))


@query
def bradley_terry_sweeps(spark, d):
    pairs = compare.expand_members(*V.order_sets(spark, d))
    return strength.bradley_terry(pairs, iterations=3, tol=0.0, accelerate=False).withColumn(
        "strength", F.round("strength", 6))


@query
def bradley_terry(spark, d):
    pairs = compare.expand_members(*V.order_sets(spark, d))
    return strength.bradley_terry(pairs)


@query
def rank_scores(spark, d):
    rows = V.scores(spark, d).select(F.col("asset_id").alias("item"),
                                     F.col("bt_score").alias("strength"))
    return strength.rank_scores(rows)


@query
def merge_scores(spark, d):
    sc = V.scores(spark, d)
    fitted = sc.filter("stars is null").select(
        F.concat(F.substring("asset_id", 1, 8), F.lit("9")).alias("item"),
        (F.col("bt_score") * 2).alias("strength")).groupBy("item").agg(
        F.max("strength").alias("strength")).withColumn("rank", F.lit(1).cast("bigint"))
    return strength.merge_scores(sc, fitted, V.moment(V.LATER)).select(
        "asset_id", F.round("bt_score", 6).alias("bt_score"), "rank", "stars",
        micros("updated_at"))


@query
def cap_candidates(spark, d):
    sc = V.scores(spark, d)
    cands = sc.select("asset_id")
    return bands.cap_candidates(cands, sc.filter("stars is null"), 37).select("asset_id")


@query
def top_pool(spark, d):
    sc = V.scores(spark, d)
    return bands.top_pool(sc, bands.five_target(sc))


@query
def pair_history(spark, d):
    return compare.pair_history(V.duel_pairs(spark, d))


def _items(spark, d) -> DataFrame:
    return V.scores(spark, d).select(F.col("asset_id").alias("item"),
                                     F.col("bt_score").alias("score"))


@query
def swiss_pairs(spark, d):
    none = spark.createDataFrame([], "a string, b string")
    return compare.swiss_pairs(_items(spark, d), none)


@query
def swiss_pairs_history(spark, d):
    _, picks = V.order_sets(spark, d)
    played = picks.filter("n > 1").select(F.col("best_id").alias("a"), F.col("worst_id").alias("b"))
    return compare.swiss_pairs(_items(spark, d), played)


@query
def reconcile_orders(spark, d):
    rows = V.duels(spark, d)
    forward = rows.select("duel_id", "a_id", "b_id", F.col("forward_pick").alias("pick"))
    reverse = rows.select("duel_id", F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"),
                          F.col("reverse_pick").alias("pick"))
    return compare.reconcile_orders(forward, reverse, ["duel_id"])


@query
def star_bands(spark, d):
    return bands.star_bands(V.scores(spark, d).select("asset_id", "bt_score"), 25, 0.3).select(
        "asset_id", "position", "stars")


@query
def fraction_bands(spark, d):
    return bands.fraction_bands(
        V.scores(spark, d).select("asset_id", "bt_score"), full=True).select(
        "asset_id", "position", "stars")


def _protected(spark, d) -> DataFrame:
    sc, dec = V.scores(spark, d), V.part_decisions(spark, d)
    prior = bands.prior_fives(sc, dec)
    return bands.protect_fives(
        bands.fraction_bands(sc.select("asset_id", "bt_score")), prior,
        bands.external_fives(V.rated_parts(spark, d), prior))


@query
def protect_fives(spark, d):
    return _protected(spark, d).select("asset_id", "stars", "protected")


@query
def retract_stars(spark, d):
    sc, dec = bands.retract_stars(
        V.scores(spark, d), V.part_decisions(spark, d), _protected(spark, d))
    return sc.select("asset_id", "stars").join(
        dec.select("asset_id", "bucket"), "asset_id", "left")


@query
def star_tail(spark, d):
    none = spark.createDataFrame([], "asset_id string, stars int")
    return bands.star_tail(V.triage(spark, d), V.decisions(spark, d), none)


# --- merges ----------------------------------------------------------------------------------

@query
def merge_upsert(spark, d):
    target = align(V.assets(spark, d), ASSETS).select("id", "camera", "description",
                                                      "source_rating")
    lines = V.table(spark, d, "lineitem")
    updates = lines.select(
        V.key("e", "l_partkey").alias("id"),
        (F.col("l_quantity").cast("int") % 6).alias("source_rating"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
        F.col("l_suppkey").alias("s"), F.col("l_extendedprice").alias("p"))
    updates = updates.withColumn("seq", F.struct("seq", "s", "p")).drop("s", "p")
    return merges.merge_upsert(target, updates, "id", "seq")


@query
def merge_triage(spark, d):
    t = V.triage(spark, d)
    new = t.filter("confidence = 'high'").withColumn("caption", F.lit("")).withColumn(
        "verdict", F.lit("neutral"))
    return merges.merge_triage(t, new).select(
        "asset_id", "verdict", "caption", micros("enriched_at"), joined("keywords"))


@query
def merge_bursts(spark, d):
    a = V.grouped_assets(spark, d)
    old, new = V.bursts(a), V.bursts(a, all_groups=True).drop("applied_at").withColumn(
        "reject_ids", F.when(F.col("burst_id").like("%7"), F.array().cast("array<string>"))
        .otherwise(F.col("reject_ids")))
    return merges.merge_bursts(old, new).select(
        "burst_id", "winner_id", joined("reject_ids"), micros("applied_at"))


@query
def merge_decisions(spark, d):
    old = V.decisions(spark, d)
    new = old.filter("detail like '%3%'").select(
        "asset_id", F.when(F.col("bucket") == "reject", "reject").otherwise("nonphoto")
        .alias("bucket"), F.lit("{}").alias("detail"))
    return merges.merge_decisions(old, new).select("asset_id", "bucket", micros("applied_at"))


def _resolved(spark, d):
    a = V.grouped_assets(spark, d)
    stale = align(a.filter("burst_id is not null").select(
        F.col("id").alias("asset_id"), F.lit("burst_loser").alias("bucket")),
        DECISIONS)
    return merges.resolve_bursts(
        groups.group_members(a), V.burst_verdicts(a), V.bursts(a), stale, V.moment(V.EPOCH))


@query
def resolve_bursts(spark, d):
    b, _, _ = _resolved(spark, d)
    return b.select("burst_id", "winner_id", joined("reject_ids"), "note", micros("applied_at"))


@query
def resolve_bursts_decisions(spark, d):
    return _resolved(spark, d)[1].select("asset_id", "bucket")


@query
def mark_done(spark, d):
    done = V.table(spark, d, "labels").filter("quality = 1").select(
        V.key("e", "doc_id").alias("asset_id")).unionByName(
        V.table(spark, d, "region").select(F.col("r_name").alias("asset_id")))
    dec = V.decisions(spark, d)
    return merges.mark_done(dec, "asset_id", done, now=V.moment(V.EPOCH)).select(
        "asset_id", micros("applied_at"))


@query
def count_done(spark, d):
    done = V.table(spark, d, "labels").filter("quality = 1").select(
        V.key("e", "doc_id").alias("asset_id"))
    return merges.count_done(V.decisions(spark, d), "asset_id", done)


@query
def clear_decisions(spark, d):
    gone = V.triage(spark, d).filter("verdict = 'candidate'").select("asset_id")
    return merges.clear_decisions(V.decisions(spark, d), gone).select("asset_id", "bucket")


def _ingested(spark, d):
    world = {
        "assets": align(V.assets(spark, d), ASSETS), "triage": V.triage(spark, d).limit(0),
        "bursts": V.empty_bursts(spark), "decisions": V.decisions(spark, d).limit(0),
        "batch_items": V.batch_items(spark, d), "batches": V.batches(spark, d),
    }
    return judging.ingest_results(
        V.replies(spark, d).select("custom_id", "reply", "error"), world, V.moment(V.LATER))


@query
def ingest_results(spark, d):
    _, outcomes = _ingested(spark, d)
    return outcomes.groupBy("kind").agg(
        F.count("*").alias("n"), F.count("error").alias("errors"))


@query
def ingest_results_tables(spark, d):
    after, _ = _ingested(spark, d)
    return after["triage"].join(after["decisions"], "asset_id").select(
        "asset_id", "category", "verdict", "bucket", "caption")


@query
def ingest_results_items(spark, d):
    after, _ = _ingested(spark, d)
    return after["batch_items"].groupBy("batch_id").agg(
        F.count("result").alias("results"), F.count("error").alias("errors")).join(
        after["batches"].select("batch_id", "status"), "batch_id")


@query
def register_batch(spark, d):
    items = V.batch_items(spark, d).withColumn("result", F.lit("old"))
    queued = V.verdicts(spark, d).filter("category = 'photo'").select(
        F.when(F.col("verdict") == "reject", F.concat(F.lit("triage_"), "asset_id"))
        .otherwise(F.concat(F.lit("burst_"), "asset_id")).alias("custom_id"),
        F.lit("b9").alias("batch_id"), F.lit("{}").alias("payload"))
    i, b = merges.register_batch(items, V.batches(spark, d), queued, "triage",
                                 V.moment(V.EPOCH))
    return i.groupBy("batch_id", "kind").agg(
        F.count("*").alias("n"), F.count("result").alias("results")).join(
        b.select("batch_id", "status"), "batch_id")


@query
def set_batch_status(spark, d):
    ids = V.batches(spark, d).filter("batch_id > 'b0'").select("batch_id")
    rows = merges.set_batch_status(V.batches(spark, d), ids, "ingested", V.moment(V.EPOCH))
    return rows.select("batch_id", "status", micros("ingested_at"))


# --- action planning -------------------------------------------------------------------------

@query
def asset_actions(spark, d):
    dec = V.decisions(spark, d).unionByName(V.part_decisions(spark, d))
    plan = actions.asset_actions(dec, tag_root="t")
    return actions.exploded_ops(plan).join(
        plan.select("sort_key", "description").withColumnRenamed("description", "line"),
        "sort_key").select("sort_key", "group", "bucket", "burst_id", "op_no", "op", "asset_id",
                           "rating", "visibility", "is_favorite", "tag", "line")


@query
def stack_actions(spark, d):
    a = V.grouped_assets(spark, d)
    return actions.exploded_ops(actions.stack_actions(V.bursts(a), a)).select(
        "burst_id", "group", joined("asset_ids"))


@query
def enrich_actions(spark, d):
    plan = actions.enrich_actions(
        V.triage(spark, d), align(V.assets(spark, d), ASSETS), True, True, "kw")
    return actions.exploded_ops(plan).select("sort_key", "op_no", "op", "description", "tag")


@query
def album_action(spark, d):
    plan = actions.album_action(V.part_decisions(spark, d), "Best", 4)
    return actions.exploded_ops(plan).select("group", "op", "name", "asset_id")


@query
def plan(spark, d):
    return _part_plan(spark, d).groupBy("stage", "group", "bucket").agg(
        F.count("*").alias("n"), F.sum(F.size("ops")).alias("ops"),
        F.min("sort_key").alias("first"), F.max("sort_key").alias("last"))


@query
def select_groups(spark, d):
    return actions.select_groups(_part_plan(spark, d), "reject,enrich").groupBy("group").agg(
        F.count("*").alias("n"))


def _outcomes(plan: DataFrame) -> DataFrame:
    """Every operation succeeds but archiving of memes and tags on ids ending in 7."""
    ops = actions.exploded_ops(plan)
    bad = ((F.col("op") == "tag") & F.col("asset_id").like("%7")) | (
        (F.col("op") == "update_asset") & F.col("asset_id").like("%3"))
    return ops.select("stage", "sort_key", "op_no", (~F.coalesce(bad, F.lit(False))).alias("ok"))


@query
def reconcile(spark, d):
    p = _part_plan(spark, d)
    return actions.reconcile(p, _outcomes(p))["counters"]


@query
def reconcile_stamps(spark, d):
    p = _part_plan(spark, d)
    done = actions.reconcile(p, _outcomes(p))
    return done["decisions"].select(F.lit("decision").alias("what"), "asset_id").unionByName(
        done["enriched"].select(F.lit("enrich").alias("what"), "asset_id"))


@query
def write_actions(spark, d):
    path = _scratch(spark, "actions")
    write_plan(_part_plan(spark, d), path, dry_run=False)
    written = spark.read.parquet(path)
    done = actions.reconcile(written, _outcomes(written))
    return done["decisions"].select(F.lit("decision").alias("what"), "asset_id").unionByName(
        done["enriched"].select(F.lit("enrich").alias("what"), "asset_id"))


# --- report ----------------------------------------------------------------------------------

@query
def report_keepers(spark, d):
    return report.report_keepers(
        V.part_decisions(spark, d), V.scores(spark, d), V.rated_parts(spark, d),
        V.triage(spark, d, "p")).withColumn("reasons", F.array_join("reasons", "; "))


@query
def report_rejects(spark, d):
    return report.report_rejects(
        V.decisions(spark, d), V.triage(spark, d), align(V.assets(spark, d), ASSETS)
    ).withColumn("reasons", F.array_join("reasons", "; "))


@query
def report_nonphotos(spark, d):
    return report.report_nonphotos(
        V.decisions(spark, d), V.triage(spark, d), align(V.assets(spark, d), ASSETS)
    ).withColumn("reasons", F.array_join("reasons", "; "))


@query
def report_bursts(spark, d):
    a = V.grouped_assets(spark, d)
    return report.report_bursts(a, V.bursts(a)).withColumn(
        "taken_at", F.unix_micros("taken_at"))


@query
def report_summary(spark, d):
    return report.report_summary(V.tables(spark, d))


# --- judging, streams and the full cycle -----------------------------------------------------

def label_judge(row: dict) -> dict:
    """A judge that answers from the row: prose around JSON, some replies unusable."""
    n = int(row["n_chars"])
    if n % 13 == 0:
        return {"text": "cannot tell", "input_tokens": 5}
    if n % 17 == 0:
        return {"text": None, "stop_reason": "refusal"}
    if n % 19 == 0:
        raise OSError("unreadable")
    verdict = {
        "category": "photo" if n % 3 else "meme", "verdict": "neutral", "technical_score": n % 12,
        "reasons": [], "confidence": "high",
    }
    return {"text": f"Sure: {json.dumps(verdict)}", "input_tokens": n, "output_tokens": 7}


@query
def judge_with(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "n_chars")
    rows = judging.judge_with(docs, label_judge, "triage")
    return rows.select("doc_id", "category", "technical_score", "input_tokens", "output_tokens",
                       F.col("error").isNull().alias("usable"))


def _workspace(spark) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"


def _in_windows(frames: DataFrame, path: str, ts: str, windows: int = 3) -> int:
    """Write rows in order of equal time windows and return the width of one in seconds."""
    lo, hi = frames.agg(F.min(F.unix_seconds(ts)), F.max(F.unix_seconds(ts))).first()
    width = (hi - lo) // windows + 1
    for k in range(windows):
        frames.filter(F.floor((F.unix_seconds(ts) - lo) / width) == k).write.mode("append") \
            .parquet(path)
    return width


@query
def stream_bursts(spark, d):
    path = _workspace(spark)
    frames = V.assets(spark, d, True).select("id", "taken_at", "camera", "dhash")
    width = _in_windows(frames, f"{path}/in", "taken_at")
    stream = spark.readStream.schema(stream_ops.FRAME).option("maxFilesPerTrigger", 1).parquet(
        f"{path}/in")
    run = stream_ops.stream_bursts(stream, path, V.GAP_SECONDS, 26, V.MAX_GROUP, width)
    run.awaitTermination()
    return stream_ops.emitted_groups(spark, path).unionByName(stream_ops.open_groups(
        spark, path, run.lastProgress["batchId"], V.GAP_SECONDS, 26, V.MAX_GROUP))


@query
def watch(spark, d):
    path = _workspace(spark)
    rows = align(V.assets(spark, d), ASSETS)
    _in_windows(rows, f"{path}/in", "taken_at")
    stream = spark.readStream.schema(ASSETS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    tables = {**empty_tables(spark), "triage": V.triage(spark, d)}
    save_tables(tables, f"{path}/start")
    run = watching.watch(stream, path, once=True, start=f"{path}/start")
    run.awaitTermination()
    now = watching.latest(spark, path)
    return worklists.unjudged(now["assets"], now["triage"]).select("id")


@query
def stream_results(spark, d):
    path = _workspace(spark)
    replies = cut(V.replies(spark, d))  # four parts follow from one table
    for batch in ("b0", "b1", "b2", "b3"):
        replies.filter(F.col("batch_id") == batch).select(
            "custom_id", "reply", "error").write.mode("append").parquet(f"{path}/in")
    tables = {**empty_tables(spark), "batch_items": V.batch_items(spark, d),
              "batches": V.batches(spark, d)}
    save_tables(tables, f"{path}/start")
    # a submitted batch fills more files as tables grow, and is a micro-batch all the same
    files = len(spark.read.parquet(f"{path}/in").inputFiles())
    stream = spark.readStream.schema("custom_id string, reply string, error string").option(
        "maxFilesPerTrigger", max(1, files // 4)).parquet(f"{path}/in")
    run = watching.stream_results(stream, path, f"{path}/start", once=True)
    run.awaitTermination()
    now = watching.latest(spark, path)
    return now["decisions"].select("asset_id", "bucket")


def burst_judge(row: dict) -> dict:
    """The last frame wins, the others lose."""
    n = len(row["member_ids"])
    return {"text": json.dumps({"best_index": n, "reject_indices": list(range(1, n)),
                                "note": "last"})}


def event_judge(row: dict) -> dict:
    """A verdict from the digits of the id."""
    n = int(row["id"][1:])
    verdict = {
        "category": "photo" if n % 10 else "document",
        "verdict": "candidate" if n % 40 == 1 else "reject" if n % 7 == 3 else "neutral",
        "technical_score": n % 8, "reasons": ["r"], "confidence": "high" if n % 2 else "low",
    }
    return {"text": json.dumps(verdict), "input_tokens": 1, "output_tokens": 1}


def set_judge(row: dict) -> dict:
    """The greatest reversed id is best, the least worst."""
    keys = [m[::-1] for m in row["member_ids"]]
    return {"text": json.dumps({"best_index": keys.index(max(keys)) + 1,
                                "worst_index": keys.index(min(keys)) + 1, "note": ""})}


def pair_judge(row: dict) -> dict:
    """The greater reversed id wins."""
    a, b = row["a_id"][::-1], row["b_id"][::-1]
    return {"text": json.dumps({"winner": "A" if a > b else "B", "note": ""})}


@query
def run_cycle(spark, d):
    world = {**empty_tables(spark), "assets": align(V.assets(spark, d, True), ASSETS)}
    judges = {"burst": burst_judge, "triage": event_judge, "bws": set_judge, "pair": pair_judge}
    options = Options(burst_gap_seconds=V.GAP_SECONDS, burst_max_group=V.MAX_GROUP)
    tables, _ = cycle.run_cycle(world, judges, options)
    return report.report_summary(tables)
