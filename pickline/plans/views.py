"""The engine's tables seen in a star schema with events, documents and line items.

Every view is a plain transformation of parquet tables, so the operators can be run and checked
on any data of that shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pickline.functions.scalars import dhash_bits, triage_bucket
from pickline.operators.groups import assign_groups, burst_groups, group_members, keyed_groups
from pickline.operators.ordering import segments
from pickline.operators.skew import HOT_ROWS, attach
from pickline.schemas import (
    ASSETS, BATCH_ITEMS, BATCHES, BURSTS, BWS_SETS, DECISIONS, PAIRS, SCORES, TRIAGE, align,
)
from pickline.session import cut

GAP_SECONDS = 3600.0
MAX_GROUP = 3
SET_SIZE = 8
HASH_SIZE = 7
EPOCH = "2024-01-01 00:00:00"
LATER = "2024-02-02 00:00:00"
PRICES = (("alpha", 1.0, 5.0), ("alpha-2", 3.0, 15.0), ("alpha-2-mini", 5.0, 25.0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; the session works in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(prefix: str, col: str) -> Column:
    """A sortable text id."""
    return F.concat(F.lit(prefix), F.lpad(F.col(col).cast("string"), 8, "0"))


def moment(text: str) -> Column:
    """A fixed timestamp."""
    return F.lit(text).cast("timestamp")


def hashes(spark, d) -> DataFrame:
    """Difference hash of every embedding, its first floats read as a grid."""
    return table(spark, d, "embeddings").select(
        "vec_id", dhash_bits(F.col("embedding"), HASH_SIZE).alias("dhash")
    )


def write_images(spark, d, path: str) -> None:
    """Every embedding as an 8 x 9 grey bitmap file in a folder of its id.

    All 64 floats are read as 8 rows, each with its first one repeated at the end. The file is made
    of text in hexadecimal: a header, then rows from the bottom up, three bytes a pixel, padded to four.
    Tasks move their many files into place themselves; the driver would do so one after the other.
    """
    def pixel(row, col):
        value = F.get("embedding", (8 * row + col % 8).cast("int"))
        level = F.floor((value.cast("double") + 1) * 127.5)
        shade = F.greatest(F.lit(0), F.least(F.lit(255), F.coalesce(level, F.lit(0))))
        return F.repeat(F.lpad(F.hex(shade), 2, "0"), F.lit(3))

    def line(row):
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda c: pixel(row, c)), ""), F.lit("00"))

    def number(value, size):
        return value.to_bytes(size, "little").hex()

    body = 8 * 28
    header = ("424d" + number(54 + body, 4) + number(0, 4) + number(54, 4) + number(40, 4) + number(9, 4) + number(8, 4)
              + number(1, 2) + number(24, 2) + number(0, 4) + number(body, 4) + number(0, 16))
    rows = F.array_join(F.transform(F.sequence(F.lit(7), F.lit(0)), line), "")
    table(spark, d, "embeddings").select(
        "vec_id", F.unhex(F.concat(F.lit(header), rows)).cast("string").alias("value")
    ).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("vec_id").text(path)


def assets(spark, d, hashed: bool = False) -> DataFrame:
    """Events as assets: the user is the camera, and every embedding is dealt to some events."""
    vectors = max(1, table(spark, d, "embeddings").count())
    rows = table(spark, d, "events").select(
        key("e", "event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("taken_at"),
        F.concat(F.lit("user|"), F.col("user_id").cast("string")).alias("camera"),
        (F.col("event_id") % vectors).alias("vec_id"),
        (F.floor("value").cast("int") % 6).alias("source_rating"),
        F.when(F.col("event_id") % 3 == 0, "mine").alias("description"),
        "value", "event_type", "props",
    )
    if not hashed:
        return rows
    return rows.join(hashes(spark, d), "vec_id", "left")


def empty_bursts(spark) -> DataFrame:
    """A burst table without rows."""
    return spark.createDataFrame([], BURSTS)


def grouped_assets(spark, d) -> DataFrame:
    """Events as assets with hashes and stamped groups."""
    rows = assets(spark, d, hashed=True)
    groups = burst_groups(rows, GAP_SECONDS, 26, MAX_GROUP)
    slices = groups.select(
        F.col("group_id").alias("component"), F.lit(0).alias("slice"), "member"
    )
    stamped = assign_groups(rows, keyed_groups(slices))
    extra = stamped.select("id", "value", "event_type")
    return cut(align(stamped, ASSETS).join(extra, "id"))


def dup_groups(spark, d) -> DataFrame:
    """Documents with equal text as duplicate groups ``(group_id, member)``."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    digest = docs.select("doc_id", F.sha2("text", 256).alias("h"))
    # equal texts are grouped by a digest first, so whole texts are not shuffled
    least = digest.groupBy("h").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n"))
    return attach(digest, least.filter("n >= 2"), "h", "n").select(
        "group_id", F.col("doc_id").alias("member")
    )


def neighbour_groups(spark, d) -> DataFrame:
    """Documents ``2k`` and ``2k + 1`` as groups ``(group_id, seq, member)``."""
    docs = table(spark, d, "documents").select("doc_id")
    return docs.select(
        F.floor(F.col("doc_id") / 2).alias("group_id"), F.col("doc_id").alias("seq"),
        F.col("doc_id").alias("member"),
    )


def verdicts(spark, d, prefix: str = "e") -> DataFrame:
    """Labels as verdicts; with prefix ``e`` they judge the first events."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "text")
    rows = table(spark, d, "labels").join(docs, "doc_id")
    doc = F.col("doc_id")
    return rows.select(
        key(prefix, "doc_id").alias("asset_id"),
        F.when(F.col("toxic") == 0, "photo").when(doc % 4 == 0, "screenshot")
        .when(doc % 4 == 1, "document").when(doc % 4 == 2, "meme").otherwise("other")
        .alias("category"),
        F.when(F.col("quality") == 0, "reject").when(doc % 5 == 0, "candidate")
        .otherwise("neutral").alias("verdict"),
        (F.col("n_chars") % 11).cast("int").alias("technical_score"),
        F.when(doc % 3 == 0, "high").when(doc % 3 == 1, "medium").otherwise("low")
        .alias("confidence"),
        F.when(doc % 4 != 0, F.col("text")).alias("caption"),
        F.array(F.concat(F.lit("len "), (F.col("n_chars") % 7).cast("string")),
                F.concat(F.lit("doc "), (doc % 9).cast("string"))).alias("reasons"),
        F.when(doc % 6 == 0, F.array(F.lit("beach"), F.concat(F.lit("k"), (doc % 4).cast("string"))))
        .alias("keywords"),
        F.when(doc % 8 == 1, moment(LATER)).alias("enriched_at"),
        doc.alias("doc_id"),
    )


def triage(spark, d, prefix: str = "e") -> DataFrame:
    return align(verdicts(spark, d, prefix), TRIAGE)


def decisions(spark, d, prefix: str = "e") -> DataFrame:
    """The decision each verdict leads to, with stars for the highest scores."""
    rows = verdicts(spark, d, prefix)
    score = F.col("technical_score")
    base = triage_bucket(F.col("category"), F.col("verdict"), F.col("confidence"))
    bucket = F.when((base == "middle") & (score == 10), "five_star").when(
        (base == "middle") & (score == 9), "four_star").when(
        (base == "middle") & (score == 0), "burst_loser").otherwise(base)
    return align(rows.select(
        "asset_id", bucket.alias("bucket"),
        F.to_json(F.struct("category", F.concat(F.lit("b"), F.col("doc_id") % 10)
                           .alias("burst_id"))).alias("detail"),
        moment(EPOCH).alias("decided_at"),
        F.when(F.col("doc_id") % 7 == 0, moment(LATER)).alias("applied_at"),
    ), DECISIONS)


def burst_verdicts(grouped: DataFrame) -> DataFrame:
    """1-based picks for every group: the greatest value wins, purchases are spared."""
    members = grouped.filter("burst_id is not null").select(
        "burst_id", "id", "value", "event_type", "taken_at"
    )
    # a group holds at most MAX_GROUP members
    ordered = members.groupBy("burst_id").agg(
        F.array_sort(F.collect_list(F.struct("taken_at", "id", "value", "event_type"))).alias("m")
    )
    best = F.array_max(F.transform("m", lambda f: F.struct(f["value"], f["id"])))["id"]
    numbered = F.transform("m", lambda f, i: F.struct(f["id"].alias("id"),
                                                      f["event_type"].alias("t"),
                                                      (i + 1).cast("int").alias("i")))
    return ordered.withColumn("best", best).withColumn("n", numbered).select(
        "burst_id",
        F.filter("n", lambda f: f["id"] == F.col("best"))[0]["i"].alias("best_index"),
        F.transform(
            F.filter("n", lambda f: (f["id"] != F.col("best")) & (f["t"] != "purchase")),
            lambda f: f["i"],
        ).alias("reject_indices"),
        F.concat(F.lit("best of "), F.size("m").cast("string")).alias("note"),
    )


def bursts(grouped: DataFrame, all_groups: bool = False) -> DataFrame:
    """Recorded group verdicts, for groups whose key is in the lower half unless ``all_groups``."""
    picks = burst_verdicts(grouped)
    if not all_groups:
        picks = picks.filter(F.substring("burst_id", 2, 1) < "8")
    rows = picks.join(group_members(grouped), "burst_id")
    return align(rows.select(
        "burst_id",
        F.get("member_ids", F.col("best_index") - 1).alias("winner_id"),
        F.transform("reject_indices", lambda i: F.get("member_ids", i - 1)).alias("reject_ids"),
        "note",
        F.when(F.substring("burst_id", 3, 1) < "4", moment(LATER)).alias("applied_at"),
    ), BURSTS)


def order_sets(spark, d, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Orders as best-worst sets of parts: ``members`` and ``picks``.

    The parts of an order with more than eight are dealt out in order over several sets, so no set
    grows with its order. The dearest line is best and the cheapest worst. Lines are shuffled once, by
    order; only orders with more than ``hot_rows`` lines are numbered by range, see :func:`segments`.
    """
    lines = table(spark, d, "lineitem").filter("l_orderkey is not null").select(
        "l_orderkey", "l_partkey", F.col("l_extendedprice").alias("quality"))
    hot = cut(lines.groupBy("l_orderkey").agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows)
              .select("l_orderkey"))
    has_hot = not hot.isEmpty()
    usual = lines.join(F.broadcast(hot), "l_orderkey", "left_anti") if has_hot else lines
    order = Window.partitionBy("l_orderkey")
    dealt = usual.repartition("l_orderkey").groupBy("l_orderkey", "l_partkey").agg(
        F.max("quality").alias("quality")
    ).select(
        "*", (F.row_number().over(order.orderBy("l_partkey")) - 1).alias("pos"),
        F.ceil(F.count("*").over(order) / SET_SIZE).alias("deals"),
    ).withColumn("deal", F.col("pos") % F.col("deals"))
    rank = F.struct("quality", "member")
    picked = {
        "best_id": F.max_by("member", rank), "worst_id": F.min_by("member", rank), "n": F.count("*"),
    }
    one = Window.partitionBy("l_orderkey", "deal")
    rows = cut(dealt.withColumn("member", key("p", "l_partkey")).select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("deal").cast("string")).alias("set_id"),
        "member", "quality", *[c.over(one).alias(name) for name, c in picked.items()],
        (F.col("pos") < F.col("deals")).alias("opens"),
    ))
    members = rows.select("set_id", "member", "quality")
    picks = rows.filter("opens").select("set_id", *picked)
    if has_hot:
        more = cut(_hot_members(lines.join(F.broadcast(hot), "l_orderkey", "left_semi")))
        members = members.unionByName(more)
        picks = picks.unionByName(more.groupBy("set_id").agg(*[c.alias(name) for name, c in picked.items()]))
    return members, picks


def _hot_members(lines: DataFrame) -> DataFrame:
    """The dealt parts of orders that are too large for a task."""
    parts = lines.groupBy("l_orderkey", "l_partkey").agg(F.max("quality").alias("quality"))
    placed = cut(segments(
        parts, [F.col("l_orderkey"), F.col("l_partkey")],
        lambda before, this: before["l_orderkey"] == this["l_orderkey"], F.lit(0),
    ).drop("segment", "last", "head"))
    sizes = placed.groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.ceil(F.count("*") / SET_SIZE).alias("deals")
    )
    return attach(placed, sizes, "l_orderkey", "n").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"),
                    (F.col("pos") % F.col("deals")).cast("string")).alias("set_id"),
        key("p", "l_partkey").alias("member"), "quality",
    )


def bws_sets(spark, d) -> DataFrame:
    """The same sets as recorded rows with a member array."""
    members, _ = order_sets(spark, d)
    rank = F.struct("quality", "member")
    rows = members.groupBy("set_id").agg(
        F.array_sort(F.collect_list("member")).alias("member_ids"),
        F.max_by("member", rank).alias("best_id"), F.min_by("member", rank).alias("worst_id"),
    )
    return rows.withColumn("round", F.lit(1)).withColumn("id", F.xxhash64("set_id")).select(
        *[f.name for f in BWS_SETS if f.name in ("id", "round", "member_ids", "best_id",
                                                 "worst_id")], "set_id"
    )


def duels(spark, d) -> DataFrame:
    """Suppliers of neighbouring lines of an order, judged by price and by quantity."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_suppkey").alias("k"), F.max("l_extendedprice").alias("p"),
        F.max("l_quantity").alias("q"),
    )
    a = lines.select("l_orderkey", F.col("l_linenumber").alias("line"),
                     *[F.col(c).alias(f"a_{c}") for c in "kpq"])
    b = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("line"),
                     *[F.col(c).alias(f"b_{c}") for c in "kpq"])

    def pick(x: str, y: str) -> Column:
        return F.when(F.col(x) > F.col(y), "A").when(F.col(x) < F.col(y), "B").otherwise("tie")

    return a.join(b, ["l_orderkey", "line"]).filter("a_k <> b_k").select(
        F.concat_ws("-", "l_orderkey", "line").alias("duel_id"),
        key("s", "a_k").alias("a_id"), key("s", "b_k").alias("b_id"),
        pick("a_p", "b_p").alias("forward_pick"), pick("b_q", "a_q").alias("reverse_pick"),
    )


def duel_pairs(spark, d) -> DataFrame:
    """The duels' forward picks as recorded pairs, of the finals where the line is odd."""
    rows = duels(spark, d)
    line = F.element_at(F.split("duel_id", "-"), 2).cast("int")
    return align(rows.select(
        F.xxhash64("duel_id").alias("id"), "a_id", "b_id",
        F.when(F.col("forward_pick") == "A", F.col("a_id"))
        .when(F.col("forward_pick") == "B", F.col("b_id")).otherwise("tie").alias("winner"),
        F.when(line % 2 == 1, "finals").otherwise("rank").alias("stage"),
    ), PAIRS)


def scores(spark, d) -> DataFrame:
    """Parts as scored items with tied strengths and earlier stars."""
    return align(table(spark, d, "part").select(
        key("p", "p_partkey").alias("asset_id"),
        (F.col("p_retailprice") / 1000.0).alias("bt_score"),
        F.when(F.col("p_size") % 7 == 0, 5).when(F.col("p_size") % 7 == 1, 4).alias("stars"),
    ), SCORES)


def rated_parts(spark, d) -> DataFrame:
    """Parts as assets with a source rating."""
    return align(table(spark, d, "part").select(
        key("p", "p_partkey").alias("id"), F.col("p_name").alias("filename"),
        F.when(F.col("p_size") % 11 == 0, 5).alias("source_rating"),
    ), ASSETS)


def part_decisions(spark, d) -> DataFrame:
    """Star decisions of the earlier stars, and middle or reject ones by brand."""
    return align(table(spark, d, "part").select(
        key("p", "p_partkey").alias("asset_id"),
        F.when(F.col("p_size") % 7 == 0, "five_star").when(F.col("p_size") % 7 == 1, "four_star")
        .when(F.col("p_brand") == "Brand#1", "reject").otherwise("middle").alias("bucket"),
        moment(EPOCH).alias("decided_at"),
    ), DECISIONS)


def replies(spark, d) -> DataFrame:
    """Verdicts as reply texts: prose around JSON, some cut short, some failed."""
    rows = verdicts(spark, d)
    doc = F.col("doc_id")
    body = F.to_json(F.struct("category", "verdict", "technical_score", "reasons", "confidence",
                              "caption", "keywords"))
    body = F.concat(F.lit("Here it is: "), body, F.lit(" Done."))
    failed = F.when(doc % 11 == 0, "errored")
    return rows.select(
        F.concat(F.lit("triage_"), "asset_id").alias("custom_id"),
        F.when(failed.isNull(), F.when(doc % 7 == 0, F.substring(body, 1, 20)).otherwise(body))
        .alias("reply"),
        failed.alias("error"),
        F.concat(F.lit("b"), (doc % 4).cast("string")).alias("batch_id"),
    )


def batch_items(spark, d) -> DataFrame:
    return align(replies(spark, d).select("custom_id", "batch_id", F.lit("triage").alias("kind")),
                 BATCH_ITEMS)


def batches(spark, d) -> DataFrame:
    """Four batches derived from the items; b0 and b1 are ingested."""
    rows = batch_items(spark, d).select("batch_id").distinct()
    return align(rows.select(
        "batch_id", F.lit("triage").alias("kind"),
        F.when(F.col("batch_id") < "b2", "ingested").otherwise("submitted").alias("status"),
        moment(EPOCH).alias("submitted_at"),
        F.when(F.col("batch_id") < "b2", moment(LATER)).alias("ingested_at"),
    ), BATCHES)


def usage(spark, d) -> DataFrame:
    """Conversations as token usage of three models."""
    role = F.col("role")
    return table(spark, d, "conversations").select(
        F.when(role == "user", "alpha-2-mini-2024").when(role == "assistant", "alpha-2")
        .otherwise("beta").alias("model"),
        F.length("text").cast("bigint").alias("input_tokens"),
        (F.col("turn") * 10 + 1).alias("output_tokens"),
        (F.col("conv_id") % 2 == 0).alias("batch"),
    )


def prices(spark) -> DataFrame:
    return spark.createDataFrame(list(PRICES), "prefix string, price_in double, price_out double")


def tables(spark, d) -> dict[str, DataFrame]:
    """The whole table set of the event world."""
    grouped = grouped_assets(spark, d)
    return {
        "assets": align(grouped, ASSETS),
        "triage": triage(spark, d),
        "bursts": bursts(grouped),
        "bws_sets": align(bws_sets(spark, d), BWS_SETS),
        "pairs": duel_pairs(spark, d),
        "scores": scores(spark, d),
        "decisions": decisions(spark, d),
        "batches": batches(spark, d),
        "batch_items": batch_items(spark, d),
    }
