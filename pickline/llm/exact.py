"""Exact deduplication by a heavy-hitter split, in DataFrame operations only.

Misra-Gries summaries of the digests (Spark's frequent-items sketch, a Misra-Gries variant with
mergeable counters) name the digests that may be frequent. Exact counts of just these are verified
winners, few enough to be broadcast, so their rows are settled where they lie and never shuffled.
All other digests are rare by the summary's bound and use an ordinary shuffle on the digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pickline.llm.common import narrowed, table, whole_text
from pickline.session import cut

#: Counters of one summary. A digest without a counter has fewer rows than about the input's rows
#: divided by three quarters of this.
TRACKED = 8192
#: Most digests treated as heavy: 4,096 rows of about 120 bytes are broadcast.
HEAVY = 4096
#: Summaries are merged in this many groups of tasks before the last merge.
MERGES = 64


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, row, digest)`` written once; ``row`` tells repeated rows apart."""
    return cut(
        narrowed(docs, doc_id=id_col, text=text_col).select(
            "doc_id",
            F.monotonically_increasing_id().alias("row"),
            F.sha2(whole_text("text"), 256).alias("digest"),
        )
    )


def heavy_winners(digests: DataFrame, tracked: int = TRACKED, heavy: int = HEAVY) -> DataFrame:
    """``(digest, last, n)`` for at most ``heavy`` digests that the summaries call frequent.

    The summaries only propose; ``last`` (greatest id and row) and ``n`` are exact.
    """
    proposed = (
        digests.select(
            F.xxhash64("digest").alias("h"), F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("g")
        )
        .groupBy("g").agg(F.expr(f"approx_top_k_accumulate(h, {tracked})").alias("s"))
        .withColumn("all", F.col("g") * 0).groupBy("all").agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"))
        .select(F.explode(F.expr(f"approx_top_k_estimate(s, {heavy})")).alias("t"))
        .select(F.col("t.item").alias("h"))
    )
    return cut(
        digests.join(F.broadcast(proposed), F.xxhash64("digest") == F.col("h"), "left_semi")
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count("*").alias("n"))
        .filter("n > 1")
    )


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tracked: int = TRACKED,
    heavy: int = HEAVY,
) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, keep_id, group_size, kept, text_sha256)``.

    Texts are equal when their UTF-8 bytes are, told by SHA-256. Of equal texts the row with the
    greatest id stays. Nulls: a null text counts as the empty text; a null id is less than any
    other, and a group with null ids alone has a null ``keep_id``. Repeated rows are copies like
    any other: exactly one row of a group has ``kept``, also if the greatest id occurs twice. An
    empty table gives no rows. Other columns of ``docs`` are not read.
    """
    digests = _digests(docs, id_col, text_col)
    winners = heavy_winners(digests, tracked, heavy)
    settled = digests.join(F.broadcast(winners), "digest")
    group = W.partitionBy("digest")
    rest = digests.join(F.broadcast(winners), "digest", "left_anti").select(
        "digest", "doc_id", "row",
        F.max(F.struct("doc_id", "row")).over(group).alias("last"),
        F.count("*").over(group).alias("n"),
    )
    return settled.select(*rest.columns).unionByName(rest).select(
        "doc_id",
        F.col("last.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("last.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: int
) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they came.

    The row kept is that of :func:`exact_groups`; of rows equal in id and text any one.
    """
    kept = (
        exact_groups(docs, id_col, text_col, **settings).filter("kept")
        .select(F.col("keep_id").alias("_keep_id"), F.col("text_sha256").alias("_keep_digest"))
    )
    names = docs.columns
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"),
        F.col(f"`{id_col}`").alias("_own_id"),
        F.sha2(whole_text(f"`{text_col}`"), 256).alias("_own_digest"),
    )
    return (
        packed.join(
            kept,
            (F.col("_own_digest") == F.col("_keep_digest"))
            & F.col("_own_id").eqNullSafe(F.col("_keep_id")),
            "left_semi",
        )
        .dropDuplicates(["_own_digest"]).select("_row.*")
    )


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts."""
    return exact_groups(table(spark, sf_dir, "documents"))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
"""
