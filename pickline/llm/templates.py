"""Line deduplication by a log-template tree.

A line goes down a tree of fixed depth: first by its token count, then by its leading tokens; tokens
with a digit count as one variable field ``<*>``. Below, fields are generalised: the rest of the
line is cut in ``PARTS`` equal stretches, and lines that differ within one stretch share the
template with that stretch variable, so they agree in three quarters of it or more. A line is thus
in at most ``1 + PARTS`` templates, told by hashes that add up over tokens, and lines never have to
be compared with each other.

A template is boilerplate if it recurs in documents that differ otherwise. Each document has a
sketch, the least hash of its own lines, which have no template of ``LEAST_DOCS`` texts, or of its
other lines if it has no own ones; copies of one document share theirs. A template is
dropped if its documents have ``LEAST_DOCS`` sketches or more, and no fewer sketches than half its
documents: boilerplate among different documents passes, lines of copied documents don't. Documents
of equal text count as one, so that exact copies of one page don't outvote the others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickline.llm.common import table, whole_text
from pickline.llm.shingles import mix, slices
from pickline.session import cut

LEAST_DOCS = 10
LEADING = 3
PARTS = 4
#: Shorter lines have no variable stretch, only variable fields.
LEAST_TOKENS = 8

_FIELD = np.uint64(0x5851F42D4C957F2D)
_COUNT = np.uint64(0x2545F4914F6CDD1D)


def line_templates(texts, leading: int = LEADING, parts: int = PARTS):
    """Of every line of an Arrow string array: text, line number, token count and template hashes.

    The first hash is that of the line with variable fields only; the others, 0 where there is
    none, have one stretch variable. Lines are what line feeds separate.
    """
    import pyarrow.compute as pc

    split = pc.split_pattern(texts, "\n")
    lines = split.flatten()
    per_text = np.diff(split.offsets.to_numpy())
    doc = np.repeat(np.arange(len(per_text)), per_text)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    tokens = pc.ascii_split_whitespace(lines)
    coded = tokens.flatten().dictionary_encode()
    names = np.array(coded.dictionary.to_pylist() + [None], dtype=object)[:-1]
    hashes = pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, np.uint64)
    hashes[np.asarray(pc.match_substring_regex(coded.dictionary, "[0-9]"), bool)] = _FIELD
    codes = coded.indices.to_numpy(zero_copy_only=False)
    real = (names != "")[codes] if len(names) else np.zeros(0, bool)
    kept = np.concatenate([[0], np.cumsum(real)])
    edges = kept[tokens.offsets.to_numpy() - tokens.offsets[0].as_py()]
    start, n = edges[:-1], np.diff(edges)
    place = np.arange(edges[-1]) - np.repeat(start, n)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(
        mix(hashes[codes][real] + mix(place.astype(np.uint64) + np.uint64(1))), dtype=np.uint64)])
    total = sums[start + n] - sums[start]
    found = np.zeros((len(n), 1 + parts), np.uint64)
    found[:, 0] = np.where(n > 0, mix(total + n.astype(np.uint64) * _COUNT), 0)
    long = n >= max(LEAST_TOKENS, leading + parts)
    for j in range(parts):
        low = start + leading + j * (n - leading) // parts
        high = start + leading + (j + 1) * (n - leading) // parts
        low, high = np.where(long, low, 0), np.where(long, high, 0)
        rest = total - (sums[high] - sums[low])
        found[:, 1 + j] = np.where(long, mix(rest + n.astype(np.uint64) * _COUNT + np.array([j + 1], np.uint64) * _FIELD), 0)
    return doc, number, n, found


def _sketches(doc: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per line the least hash of the document's other lines (0: none), and if it is a first one."""
    order = np.lexsort((own, doc))
    d, h = doc[order], own[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    first = np.zeros(len(doc), bool)
    first[order[new]] = True
    d, h = d[new], h[new]
    begins = np.ones(len(d), bool)
    begins[1:] = d[1:] != d[:-1]
    at = np.flatnonzero(begins)
    size = int(doc.max()) + 1 if len(doc) else 0
    least, second = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
    least[d[at]] = h[at]
    more = at[np.append(np.diff(at), len(d) - at[-1]) > 1] if len(at) else at
    second[d[more]] = h[more + 1]
    return np.where(own == least[doc], second[doc], least[doc]), first


def _key(id_col: Column, text: Column) -> tuple[Column, Column]:
    return id_col.cast("long").alias("doc_id"), F.xxhash64(text).alias("th")


def _lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, th, line, first, sketch, keys)`` for every line with a token."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for i, j in slices(batch["text"]):
                doc, number, n, found = line_templates(batch["text"].slice(i, j - i))
                there = n > 0
                doc, number, found = doc[there], number[there], found[there]
                sketch, first = _sketches(doc, found[:, 0])
                width = np.count_nonzero(found, axis=1)
                keys = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(width)]), pa.int32()),
                    pa.array(found[found != 0].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(i, j - i).take(pa.array(doc)), batch["th"].slice(i, j - i).take(pa.array(doc)),
                     pa.array(number, pa.int32()), pa.array(first), pa.array(sketch.view(np.int64)), keys],
                    ["doc_id", "th", "line", "first", "sketch", "keys"])

    return docs.mapInArrow(
        read, "doc_id long, th long, line int, first boolean, sketch long, keys array<long>")


def boilerplate(lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``(key, documents, sketches)`` of the templates to drop; documents of equal text are one."""
    each = lines.filter("first").select("th", "line", "sketch", F.explode("keys").alias("key"))
    often = cut(each.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= least_docs).select("key"))
    hits = cut(each.join(often, "key", "left_semi").distinct())
    # again by different texts: the lines of a page that is only copied are its own
    often = cut(hits.select("key", "th").distinct().groupBy("key").agg(F.count("*").alias("n"))
                .filter(F.col("n") >= least_docs).select("key"))
    hits = cut(hits.join(often, "key", "left_semi"))
    shared = hits.groupBy("th").agg(F.collect_set("line").alias("shared"))
    own = (
        lines.filter("first").select("th", "line", F.col("keys")[0].alias("own")).join(shared, "th")
        .filter(~F.array_contains("shared", F.col("line"))).groupBy("th").agg(F.min("own").alias("own"))
    )
    return (
        hits.join(own, "th", "left").withColumn("sketch", F.coalesce("own", "sketch"))
        .groupBy("key", "sketch").agg(F.count("*").alias("n"))
        .groupBy("key").agg(F.sum("n").alias("documents"), F.count("*").alias("sketches"))
        .filter((F.col("sketches") >= least_docs) & (2 * F.col("sketches") >= F.col("documents")))
    )


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  least_docs: int = LEAST_DOCS) -> DataFrame:
    """``(doc_id, th, dropped)``: line numbers to drop, for documents that have any.

    ``th`` is the hash of the text, so that rows of one id with different texts are told apart.
    """
    text = whole_text(f"`{text_col}`")
    lines = cut(_lines(docs.select(*_key(F.col(f"`{id_col}`"), text), text.alias("text"))))
    gone = cut(boilerplate(lines, least_docs).select("key"))
    return cut(
        lines.select("doc_id", "th", "line", F.explode("keys").alias("key"))
        .join(gone, "key", "left_semi")
        .groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("line")).alias("dropped"))
    )


def drop_template_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        least_docs: int = LEAST_DOCS, report: bool = False) -> DataFrame:
    """``docs`` without the lines of recurring templates; every document stays.

    All columns come as they came but the text. A null text stays null, an empty one empty, and a
    text of boilerplate alone becomes empty. Blank lines are never dropped. Null ids and repeated
    rows are documents like any other; equal texts count as one document. An empty
    table gives no rows. ``report`` gives ``(doc_id, n_lines, n_dropped, dropped, text)`` instead.
    """
    gone = dropped_lines(docs, id_col, text_col, least_docs)
    text = whole_text(f"`{text_col}`")
    own_id, own_hash = _key(F.col(f"`{id_col}`"), text)
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), own_id.alias("_id"), own_hash.alias("_th"))
    joined = packed.hint("merge").join(
        gone.withColumnsRenamed({"doc_id": "_gone_id", "th": "_gone_th", "dropped": "_dropped"}),
        F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_th") == F.col("_gone_th")), "left")
    given = F.col("_row")[text_col].cast("string")
    lines = F.split(given, "\n", -1)
    left = F.when(F.col("_dropped").isNull(), given).otherwise(
        F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("_dropped", i)), "\n"))
    if report:
        dropped = F.coalesce("_dropped", F.array().cast("array<int>"))
        return joined.select(
            F.col("_id").alias("doc_id"), F.size(F.split(F.coalesce(given, F.lit("")), "\n", -1)).alias("n_lines"),
            F.size(dropped).alias("n_dropped"), dropped.alias("dropped"), left.alias("text"))
    return joined.select(*[
        left.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])


def op6_line_templates(spark, sf_dir: str) -> DataFrame:
    """Every document with the lines that recurring templates take from it."""
    return drop_template_lines(table(spark, sf_dir, "documents"), report=True).select(
        "doc_id", "n_lines", "n_dropped", "dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
