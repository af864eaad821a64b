"""Benchmark decontamination with a distributed positional inverted index.

The index is a written table of segments. A segment holds the posting lists of some whole
documents: for every term the sorted word positions, counted through the segment with a free
position between documents, so that no phrase reaches over a border. Segments lie where their
documents lay; building them shuffles nothing and a hot term is spread over all segments.

A query phrase starts from its rarest term by counts over the whole index and intersects the
offset-adjusted lists of the next rarer terms until none is left. Test items are read in blocks of
a counted number of words; any number of blocks goes through the same index.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickline.llm.common import narrowed, table, whole_text
from pickline.llm.shingles import slices
from pickline.session import cut

WINDOW = 13
#: Words of test items in one block; an item is never split.
BLOCK_WORDS = 500_000
#: Bytes of text in one segment, unless one document has more, and segments of a file's row group: what
#: writers hold until it is full and what readers make arrays of at once.
SEGMENT_BYTES, GROUP_SEGMENTS = 512 << 10, 16

INDEX = ("segment long, doc_ids array<long>, n_words array<int>, terms array<string>, "
         "ends array<int>, deltas array<int>")
#: Bytes of words stay (A-Z as a-z), all other bytes separate them.
_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(texts):
    """Dictionary-coded words of an Arrow string array, and where each text's words end."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pa.concat_arrays([texts.fill_null("")]) if len(texts) else texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    plain = pa.StringArray.from_buffers(
        len(texts), offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(_BYTES)),
        None, 0, texts.offset)
    lists = pc.ascii_split_whitespace(plain)
    coded = lists.flatten().dictionary_encode()
    edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    names = coded.dictionary.to_pylist()
    if "" in names:  # white space at either end of a text leaves empty words
        blank = names.index("")
        real = codes != blank
        kept = np.concatenate([[0], np.cumsum(real)])
        codes, edges = codes[real], kept[edges]
        codes = codes - (codes > blank)
        del names[blank]
    return codes, names, edges[1:]


def build_index(docs: DataFrame) -> DataFrame:
    """Segments of ``docs(doc_id, text)``, written to the shared folder; all words are indexed."""

    def read(batches):
        import pyarrow as pa

        def one(values, kind):
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j in slices(batch["text"], SEGMENT_BYTES):
                codes, names, ends = words_of(batch["text"].slice(i, j - i))
                sizes = np.diff(ends, prepend=0)
                at = np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)
                order = np.argsort(codes, kind="stable")
                yield pa.RecordBatch.from_arrays([
                    pa.array([number]), one(batch["doc_id"].slice(i, j - i), pa.int64()), one(sizes, pa.int32()),
                    one(names, pa.string()), one(np.cumsum(np.bincount(codes, minlength=len(names))), pa.int32()),
                    one(np.diff(at[order], prepend=0), pa.int32())],
                    ["segment", "doc_ids", "n_words", "terms", "ends", "deltas"])
                number += 1

    return cut(docs.mapInArrow(read, INDEX), **{"parquet.block.row.count.limit": GROUP_SEGMENTS})


class Segment:
    """Posting lists of one index row, limited to given terms."""

    def __init__(self, row: dict, terms):
        import pyarrow.compute as pc

        self.sizes = row["n_words"]
        self.bases = np.cumsum(self.sizes + 1) - self.sizes - 1
        own = pc.index_in(terms, value_set=row["terms"])
        self.has = np.asarray(own.is_valid())
        self.place = own.fill_null(0).to_numpy(zero_copy_only=False)
        self.ends = row["ends"]
        self.positions = np.cumsum(row["deltas"], dtype=np.int64)

    def postings(self, term: int) -> np.ndarray:
        at = self.place[term]
        return self.positions[self.ends[at - 1] if at else 0 : self.ends[at]]

    def phrase(self, terms: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of a phrase, its terms given from the rarest on with their offsets."""
        starts = self.postings(terms[0]) - offsets[0]
        for term, offset in zip(terms[1:], offsets[1:], strict=True):
            if not len(starts):
                break
            listed, want = self.postings(term), starts + offset
            at = np.minimum(np.searchsorted(listed, want), len(listed) - 1)
            starts = starts[listed[at] == want]
        return starts

    def near(self, terms: np.ndarray, span: int) -> np.ndarray:
        """First positions of the shortest stretches of ``span`` words at most with all terms."""
        lists = [self.postings(t) for t in terms]
        around = np.ones(len(lists[0]), bool)
        for other in lists[1:]:
            around &= np.searchsorted(other, lists[0] + span) > np.searchsorted(other, lists[0] - span, "right")
        found = set()
        for p in lists[0][around].tolist():
            close = sorted((q, k) for k, other in enumerate(lists) for q in other[
                np.searchsorted(other, p - span, "right"): np.searchsorted(other, p + span)].tolist())
            last = {}
            for q, k in close:
                last[k] = q
                if len(last) == len(lists) and q - min(last.values()) < span and p in last.values():
                    found.add(min(last.values()))
        return np.array(sorted(found), np.int64)


def _segments(batches, terms):
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch[c][k].values for c in ("doc_ids", "n_words", "terms", "ends", "deltas")}
            row |= {c: row[c].to_numpy(zero_copy_only=False) for c in ("n_words", "ends", "deltas")}
            yield batch["segment"][k].as_py(), row["doc_ids"].to_pylist(), Segment(row, terms)


def term_counts(index: DataFrame, terms: list[str]) -> dict[str, int]:
    """Occurrences of each term in the whole index."""
    wanted = index.sparkSession.sparkContext.broadcast(terms)

    def read(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        names = pa.array(wanted.value, pa.string())
        sums = np.zeros(len(names), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                own = pc.index_in(names, value_set=batch["terms"][k].values)
                counts = np.append(np.diff(batch["ends"][k].values.to_numpy(zero_copy_only=False), prepend=0), 0)
                sums += counts[own.fill_null(len(counts) - 1).to_numpy(zero_copy_only=False)]
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(sums[there])], ["term", "n"])

    found = index.select("terms", "ends").mapInArrow(read, "term long, n long")
    return {terms[r.term]: r.n for r in found.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def windows_of(items: list[tuple[int, str]], size: int = WINDOW) -> dict[tuple[str, ...], list[int]]:
    """Every distinct window of ``size`` words (a shorter item as a whole) and the items with it."""
    import pyarrow as pa

    codes, names, ends = words_of(pa.array([t for _, t in items], pa.string()))
    found, begin = defaultdict(set), 0
    for (item, _), end in zip(items, ends.tolist(), strict=True):
        own = [names[c] for c in codes[begin:end]]
        begin = end
        for i in range(max(1, len(own) - size + 1) if own else 0):
            found[tuple(own[i : i + size])].add(item)
    return {w: sorted(ids) for w, ids in found.items()}


def _blocks(items: DataFrame, block_words: int) -> list[list[tuple[int, str]]]:
    """How the items are read: as rows of ``(block, item_id, text)``, a block at a time."""
    sized = cut(items.filter("item_id is not null and text is not null").withColumn(
        "w", F.length("text") / 2 + 1))
    total = sized.agg(F.sum("w")).first()[0] or 0
    blocks = int(total // block_words) + 1
    for b in range(blocks):
        rows = sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield [(r.item_id, r.text) for r in rows.select("item_id", "text").collect()]


def find_phrases(index: DataFrame, items: DataFrame, size: int = WINDOW,
                 block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document ``(doc_id, n_words, spans, items)`` of windows of ``items(item_id, text)``.

    ``spans`` are the word ranges ``(start, end)`` inside occurrences, merged per block of items;
    ``items`` are the ids of items with an occurring window.
    """
    context, parts = index.sparkSession.sparkContext, []
    for block in _blocks(items, block_words):
        found = windows_of(block, size)
        terms = sorted({t for w in found for t in w})
        counts = term_counts(index, terms)
        number = {t: i for i, t in enumerate(terms)}
        plan = []
        for w, ids in found.items():
            if all(t in counts for t in w):
                order = sorted(range(len(w)), key=lambda k, w=w: (counts[w[k]], k))
                plan.append(([number[w[k]] for k in order], order, len(w), ids))
        parts.append(_match(index, context.broadcast((terms, plan)), everything=not parts))
    if len(parts) == 1:
        return parts[0].drop("segment", "doc")
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy("segment", "doc").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    ).drop("segment", "doc")


def _match(index: DataFrame, shared, everything: bool) -> DataFrame:
    def read(batches):
        import pandas as pd
        import pyarrow as pa

        names, plan = shared.value
        terms = pa.array(names, pa.string())
        widest = max((len(p[0]) for p in plan), default=1)
        grid = np.array([p[0] + p[0][:1] * (widest - len(p[0])) for p in plan], np.int64).reshape(-1, widest)
        for segment, doc_ids, own in _segments(batches, terms):
            spans, items = defaultdict(list), defaultdict(set)
            for k in np.flatnonzero(own.has[grid].all(1)) if len(grid) else ():
                numbers, offsets, width, ids = plan[k]
                starts = own.phrase(np.array(numbers), np.array(offsets))
                docs = np.searchsorted(own.bases, starts, "right") - 1
                for doc, s in zip(docs.tolist(), (starts - own.bases[docs]).tolist(), strict=True):
                    spans[doc].append((s, s + width))
                    items[doc].update(ids)
            rows = range(len(doc_ids)) if everything else sorted(spans)
            yield pd_batch(pa, segment, rows, doc_ids, own.sizes, spans, items)

    def pd_batch(pa, segment, rows, doc_ids, sizes, spans, items):
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(),
                 pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.int64()))
        columns = [
            [segment] * len(rows), list(rows), [doc_ids[r] for r in rows], [int(sizes[r]) for r in rows],
            [[{"start": s, "end": e} for s, e in _merge(spans.get(r, ()))] for r in rows],
            [sorted(items.get(r, ())) for r in rows]]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
            ["segment", "doc", "doc_id", "n_words", "spans", "items"])

    return index.mapInArrow(
        read, "segment long, doc int, doc_id long, n_words long, "
              "spans array<struct<start: long, end: long>>, items array<long>")


def _merge(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_near(index: DataFrame, queries: list[tuple[int, str]], span: int) -> DataFrame:
    """``(doc_id, query_id, start)``: shortest stretches of ``span`` words with all of a query's words.

    ``queries`` are ``(query_id, words)``; both are held in every task. A query without words, or
    with a word that the index lacks, has no match.
    """
    found = {i: sorted({t for w in windows_of([(i, q)], len(q) + 1) for t in w}) for i, q in queries}
    names = sorted({t for w in found.values() for t in w})
    counts, number = term_counts(index, names), {t: i for i, t in enumerate(names)}
    plan = [(i, [number[t] for t in sorted(w, key=counts.get)]) for i, w in found.items()
            if w and all(t in counts for t in w)]
    shared = index.sparkSession.sparkContext.broadcast((names, plan))

    def read(batches):
        import pyarrow as pa

        names, plan = shared.value
        for _, doc_ids, own in _segments(batches, pa.array(names, pa.string())):
            out = []
            for query, numbers in plan:
                if own.has[numbers].all():
                    for s in own.near(np.array(numbers), span).tolist():
                        doc = int(np.searchsorted(own.bases, s, "right")) - 1
                        # a stretch over a border is no match
                        last = [p for t in numbers for p in own.postings(t)[np.searchsorted(own.postings(t), s):][:1].tolist()]
                        if len(last) == len(numbers) and max(last) <= own.bases[doc] + own.sizes[doc]:
                            out.append((doc_ids[doc], query, s - int(own.bases[doc])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)],
                                                 ["doc_id", "query_id", "start"])

    return index.mapInArrow(read, "doc_id long, query_id long, start long")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  size: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``.

    Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. ``items`` has
    ``(item_id, text)``; a word is hit inside an occurrence of any of an item's windows of ``size``
    words, or of all its words if it has fewer. Contaminated is a document with a hit in a twentieth
    of its words or more. A null or empty text has no words; items with a null id or text, or
    without words, have no windows; repeated items count once, repeated rows are judged alike. Empty
    tables give no rows, or rows without hits. Other columns are not read.
    """
    index = build_index(narrowed(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long"), whole_text("text").alias("text")))
    found = find_phrases(index, items.select(F.col("item_id").cast("long"), F.col("text")), size, block_words)
    covered = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["to"]))).alias("n"),
            F.greatest(a["to"], x["end"]).alias("to")),
        lambda a: a["n"])
    return found.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256)
        .alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    **settings) -> DataFrame:
    """``docs`` without the contaminated ones, all columns as they came."""
    key = F.xxhash64(F.col(f"`{id_col}`"), whole_text(f"`{text_col}`"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key.alias("_key"))
    own = docs.select(key.alias("doc_id"), whole_text(f"`{text_col}`").alias("text"))
    found = cut(contamination(own, items, **settings).filter("contaminated").select("doc_id").distinct())
    return packed.join(found, F.col("_key") == F.col("doc_id"), "left_anti").select("_row.*")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document against all windows of the benchmark."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"""regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS size, array_to_string(w[k : k + least({WINDOW}, len(w)) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
g AS (SELECT r, size, k, array_to_string(w[k : k + size - 1], ' ') AS g
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM i))),
m AS (SELECT DISTINCT r, item_id, k, size FROM g JOIN i USING (size, g)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
