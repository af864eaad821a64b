"""Substring deduplication by hashing lines and clauses.

A text has units by two kinds of borders: line feeds, and marks that end sentences and clauses, for
which a line feed is a plain blank. Units are normalised (lower case, white space runs as one
blank). From each unit on, the shortest stretch of neighbouring units with enough words is hashed, so
that a passage is found however it is broken into lines and whatever stands before and after it,
while a stock phrase alone is not. Equal digests are grouped over all documents, the earliest ranked
occurrence stays and every other one is removed. Spans are kept in code points of the original text.

No word is lost: a word that goes has its like in an earlier occurrence of the stretch; where that one
goes too, there is an earlier one still, and the earliest stays.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pickline.llm.common import narrowed, table, whole_text
from pickline.session import cut

#: Words of a stretch, at least: shared text of more than twice as many holds one, wherever it is cut.
LEAST_WORDS = 25
#: Characters that end a clause.
MARKS = ".!?,;:\u2026\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f"
#: Counters of a summary of frequent digests, groups of tasks for the first merge, digests broadcast.
TRACKED, MERGES, HEAVY = 8192, 64, 4096
#: Parts that the rows of a frequent digest are spread over.
SALTS = 4096

_UNITS = {"clause": re.compile(rf"[^{MARKS}]*[{MARKS}]+|[^{MARKS}]+"), "line": re.compile(r"[^\n]+")}
_AFTER = re.compile(r"[ \t\n\v\f\r]*")
_BLANKS = str.maketrans("\t\n\v\f\r", "     ")


def units_of(text: str, kind: str) -> list[tuple[int, int, str, int]]:
    """``(start, end, normalised, words)`` of the units that are not blank, without blanks at their ends."""
    plain, found = text.translate(_BLANKS), []
    for m in _UNITS[kind].finditer(text):
        at, end = m.span()
        own = plain[at:end]
        words = [w for w in own.lower().split(" ") if w]
        if words:
            begin = at + len(own) - len(own.lstrip(" "))
            found.append((begin, begin + len(own.strip(" ")), " ".join(words), len(words)))
    return found


def stretches_of(text: str, least_words: int = LEAST_WORDS) -> set[tuple[int, int, int]]:
    """``(start, end, digest)`` of the shortest stretch of ``least_words`` from each unit on.

    Digests are the first 64 bits of SHA-256; equal ones are taken as equal text.
    """
    found = set()
    for kind in _UNITS:
        units = units_of(text, kind)
        stop, words = 0, 0
        for k, (start, _, _, own) in enumerate(units):
            while words < least_words and stop < len(units):
                words += units[stop][3]
                stop += 1
            if words < least_words:
                break
            joined = " ".join([u[2] for u in units[k:stop]])
            digest = hashlib.sha256(joined.encode("utf-8", "surrogatepass")).digest()
            found.add((start, units[stop - 1][1], int.from_bytes(digest[:8], "big", signed=True)))
            words -= own
    return found


def _heavy(stretches: DataFrame, tracked: int, heavy: int) -> DataFrame:
    """``(digest, first)`` of at most ``heavy`` digests that the summaries call frequent; ``first`` is exact."""
    proposed = (
        stretches.select("digest", F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("g"))
        .groupBy("g").agg(F.expr(f"approx_top_k_accumulate(digest, {tracked})").alias("s"))
        .withColumn("all", F.col("g") * 0).groupBy("all").agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"))
        .select(F.explode(F.expr(f"approx_top_k_estimate(s, {heavy})")).alias("t"))
        .select(F.col("t.item").alias("digest"), F.lit(True).alias("proposed"))
    )
    # all rows pass the join and those of no proposed digest meet in one partial sum per task
    firsts = cut(stretches.join(F.broadcast(proposed), "digest", "left")
                 .groupBy(F.when(F.col("proposed"), F.col("digest")).alias("digest")).agg(F.min("rank").alias("first")))
    return firsts.filter(F.col("digest").isNotNull())


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS,
                   tracked: int = TRACKED, heavy: int = HEAVY) -> DataFrame:
    """One row per stretch to remove: ``(doc_id, start, end, digest, keep_id, keep_start, th)``.

    Stretches of one text can overlap. Ranked by id, then place; a null id ranks last, rows of one
    id by a hash of their text ``th``. Rows equal in id and text are one document. A null or empty
    text has no units; an empty table gives no rows. Other columns are not read. Digests that may be
    frequent are settled by a broadcast of their counted first places, the others by a shuffle.
    """

    def read(batches):
        import pyarrow as pa

        kinds = (pa.int64(),) * 5
        for batch in batches:
            rows = []
            for i, th, t in zip(*(batch[c].to_pylist() for c in ("doc_id", "th", "text")), strict=True):
                rows += [(i, th, *u) for u in sorted(stretches_of(t, least_words))]
                if len(rows) > 100_000:
                    yield _batch(pa, rows, kinds)
                    rows = []
            if rows:
                yield _batch(pa, rows, kinds)

    own = narrowed(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long"), whole_text("text").alias("text")).withColumn("th", F.xxhash64("text"))
    stretches = cut(own.mapInArrow(read, "doc_id long, th long, start long, end long, digest long")).withColumn(
        "rank", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "start"))
    frequent = F.broadcast(_heavy(stretches, tracked, heavy).withColumnRenamed("first", "known"))
    # a frequent digest's first place is known, so its rows can be spread over the shuffle of the rest
    salt = F.when(F.col("known").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("th", "start"), F.lit(SALTS)))
    least = F.min("rank").over(W.partitionBy("digest", "salt"))
    return (
        stretches.join(frequent, "digest", "left").withColumn("salt", salt)
        .withColumn("first", F.coalesce("known", least)).filter("rank > first").select(
            "doc_id", "start", "end", F.lower(F.lpad(F.hex("digest"), 16, "0")).alias("digest"),
            F.col("first.doc_id").alias("keep_id"), F.col("first.start").alias("keep_start"), "th").distinct()
    )


def _batch(pa, rows, kinds):
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
        ["doc_id", "th", "start", "end", "digest"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with all but the first occurrence of each stretch cut out of the texts.

    White space after a removed span goes with it. All columns come as they came; a null text stays
    null.
    """
    spans = repeated_units(docs, id_col, text_col, **settings).groupBy("doc_id", "th").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                         F.col(f"`{id_col}`").cast("long").alias("_id"), F.xxhash64(whole_text(f"`{text_col}`")).alias("_th"))
    joined = packed.join(cut(spans), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_th") == F.col("th")), "left")

    @F.pandas_udf("string")
    def rest(texts, spans):
        import pandas as pd

        def one(text, gone):
            if text is None or gone is None:
                return text
            out, at = [], 0
            for s in gone:
                if s["start"] > at:
                    out.append(text[at : s["start"]])
                if s["end"] > at:
                    at = _AFTER.match(text, s["end"]).end()
            return "".join(out) + text[at:]

        return pd.Series([one(t, g) for t, g in zip(texts, spans, strict=True)], dtype=object)

    text = rest(F.col("_row")[text_col].cast("string"), F.col("_spans"))
    return joined.withColumn("_left", text).select(*[
        F.col("_left").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])


def op4_repeated_lines(spark, sf_dir: str) -> DataFrame:
    """Every stretch of 25 words or more, in whole clauses or lines, that an earlier place has already."""
    return repeated_units(table(spark, sf_dir, "documents")).drop("th")


OP4_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS (SELECT doc_id, 0 AS kind, unnest(l) AS t, generate_subscripts(l, 1) AS k, 0 AS gap
  FROM (SELECT doc_id, regexp_extract_all(t, '[^{MARKS}]*[{MARKS}]+|[^{MARKS}]+') AS l FROM d)
  UNION ALL
  SELECT doc_id, 1, unnest(l), generate_subscripts(l, 1), 1 FROM (SELECT doc_id, string_split(t, chr(10)) AS l FROM d)),
placed AS (SELECT *, coalesce(sum(length(t) + gap) OVER (PARTITION BY doc_id, kind ORDER BY k
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place,
  trim(regexp_replace(lower(t), '[ \t\n\v\f\r]+', ' ', 'g')) AS p FROM raw),
units AS (SELECT doc_id, kind, p, CAST(place + length(t) - length(ltrim(t, ' \t\n\v\f\r')) AS BIGINT) AS start,
  CAST(place + length(rtrim(t, ' \t\n\v\f\r')) AS BIGINT) AS "end",
  length(p) - length(replace(p, ' ', '')) + 1 AS w,
  row_number() OVER (PARTITION BY doc_id, kind ORDER BY k) AS k FROM placed WHERE p <> ''),
sums AS (SELECT *, CAST(sum(w) OVER (PARTITION BY doc_id, kind ORDER BY k) AS BIGINT) AS c FROM units),
lists AS (SELECT doc_id, kind, list(p ORDER BY k) AS ps FROM units GROUP BY ALL),
stretches AS (SELECT DISTINCT a.doc_id, a.start, b."end", sha256(array_to_string(ps[a.k:b.k], ' '))[1:16] AS digest
  FROM (SELECT *, c - w + {LEAST_WORDS} AS need FROM sums) a
  ASOF JOIN sums b ON a.doc_id = b.doc_id AND a.kind = b.kind AND a.need <= b.c
  JOIN lists l ON l.doc_id = a.doc_id AND l.kind = a.kind),
ranked AS (SELECT *, first_value(doc_id) OVER w AS keep_id, first_value(start) OVER w AS keep_start,
  row_number() OVER w AS rank FROM stretches WINDOW w AS (PARTITION BY digest ORDER BY doc_id, start))
SELECT doc_id, start, "end", digest, keep_id, keep_start FROM ranked WHERE rank > 1
"""
