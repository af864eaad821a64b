"""Best-fit packing of token pieces by exact complements.

Texts become token ids with an end id, and only those longer than a sequence are cut. The plan is
made on the histogram of piece lengths alone, which has at most ``size`` entries whatever the
corpus: the longest open length is completed by the single, pair or triple of available lengths
that fills its gap exactly, as often as the counts allow; where nothing fills it exactly, the
longest length that fits is added and the rest of the gap is tried again. Every step of the plan
uses up a length, so the plan is short. Pieces are then told apart by their rank among pieces of
equal length, counted per task and added up, and the rank alone says their sequence and offset.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pickline.llm.common import narrowed, table, whole_text
from pickline.llm.shingles import slices
from pickline.session import cut

SIZE = 2048
END_ID = 0
#: Bytes of text tokenized at once; a longer text is tokenized alone.
SLICE_BYTES = 2 << 20
#: Words and other chunks whose ids a task remembers, in about 200 bytes each; beyond, or for texts
#: that bring more at once, it forgets all of them.
CACHED = 300_000


def _byte_names() -> dict[int, int]:
    """The characters by which byte-level models call the bytes that don't print."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in prints]
    return {b: 256 + i for i, b in enumerate(rest)}


BYTE_NAMES = _byte_names()


# ---- tokens -------------------------------------------------------------------------------------

#: Words of letters that are one piece for the pattern, and marks that may follow one.
_LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
_MARKS = ".,;:!?"


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``begin, begin + 1, ...`` of ``count`` numbers each, one after the other."""
    stops = np.cumsum(count)
    return np.repeat(begin - stops + count, count) + np.arange(stops[-1] if len(stops) else 0)


class ChunkTokenizer:
    """Ids of whole texts from the ids of their chunks between ASCII white space.

    Right for tokenizers that drop white space and never join what it separates, as
    ``word_bpe_49k.json`` does: its pattern has no white space in a piece, and its normalizer works
    on neighbouring characters only. The distinct chunks of some texts are taken apart together: a
    plain word, in lower case, and a mark after it have ids of their own, and only words and other
    chunks that are not remembered are encoded one by one.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.others: dict[str, int] = {"": 0}
        self.flat, self.ends = array("I"), array("q", [0, 0])
        self.marks = np.array([self._add(self._whole([c])[0]) for c in _MARKS])

    def _add(self, ids: list[int]) -> int:
        self.flat.extend(ids)
        self.ends.append(len(self.flat))
        return len(self.ends) - 2

    def _whole(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _word(self, word: str) -> int:
        """Place of a word of lower-case letters below U+0100, which is its own normal form.

        The model takes its bytes as the characters that stand for them.
        """
        plain = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_NAMES)
        return self._add([t.id for t in self.model.tokenize(plain)])

    def _places(self, words: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of words and of other chunks are; all are needed together."""
        if len(self.words) + len(self.others) + len(words) + len(others) > CACHED:
            self.clear()
        known = self.words
        for word in words:
            if word not in known:
                known[word] = self._word(word)
        new = [c for c in others if c not in self.others]
        for i in range(0, len(new), 5000):
            some = new[i : i + 5000]
            self.others.update((c, self._add(ids)) for c, ids in zip(some, self._whole(some), strict=True))
        return (np.fromiter((known[w] for w in words), np.int64, len(words)),
                np.fromiter((self.others[c] for c in others), np.int64, len(others)))

    def _chunks(self, chunks) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks of an Arrow string array one after the other, and where each ends."""
        import pyarrow as pa
        import pyarrow.compute as pc

        mark = pc.index_in(pc.utf8_slice_codeunits(chunks, -1), pa.array(list(_MARKS)))
        marked = pc.is_valid(mark)
        stem = pc.if_else(marked, pc.utf8_slice_codeunits(chunks, 0, -1), chunks)
        plain = pc.match_substring_regex(stem, _LETTERS)
        coded = pc.utf8_lower(stem.filter(plain)).dictionary_encode()
        words, others = self._places(coded.dictionary.to_pylist(), chunks.filter(pc.invert(plain)).to_pylist())
        plain = plain.to_numpy(zero_copy_only=False)
        # a chunk is a word and perhaps a mark, or something else as a whole; place 0 has no ids
        place = np.zeros((len(chunks), 2), np.int64)
        place[plain, 0] = words[coded.indices.to_numpy(zero_copy_only=False)]
        place[~plain, 0] = others
        after = plain & marked.to_numpy(zero_copy_only=False)
        place[after, 1] = self.marks[mark.fill_null(0).to_numpy(zero_copy_only=False)[after]]
        ends, flat = np.frombuffer(self.ends, np.int64), np.frombuffer(self.flat, np.uint32)
        begin, count = ends[place.ravel()], ends[place.ravel() + 1] - ends[place.ravel()]
        return flat[_spread(begin, count)], np.cumsum(count)[1::2]

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of an Arrow string array one after the other, and where each ends."""
        import pyarrow.compute as pc

        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        ids, ends = self._chunks(coded.dictionary)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        stops = np.concatenate([[0], ends])
        begin, count = stops[codes], np.diff(stops)[codes]
        edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return ids[_spread(begin, count)], np.concatenate([[0], np.cumsum(count)])[edges[1:]]


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: ``(doc_id, piece, start, length, ids_crc32, part, local)``.

    ``part`` is the task that made a piece and ``local`` its rank among that task's pieces of the
    same length; ``ids`` (array) is added on request. The rows must be written before use, so that
    a task run again can't number them anew.
    """

    def cut_up(batches):
        import pyarrow as pa

        tokenizer = _tokenizer(tokenizer_path)
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            for i, j in slices(batch["text"], SLICE_BYTES):
                rows = batch.slice(i, j - i)
                ids, ends = tokenizer.encode(rows["text"])
                out, own = [], []
                begin = 0
                for doc_id, end in zip(rows["doc_id"].to_pylist(), ends.tolist(), strict=True):
                    whole = np.append(ids[begin:end], np.uint32(END_ID)).astype("<u4")
                    begin = end
                    for k, at in enumerate(range(0, len(whole), size)):
                        piece = whole[at : at + size]
                        n = len(piece)
                        out.append((doc_id, k, at, n, zlib.crc32(piece), part, int(seen[n])))
                        seen[n] += 1
                        if with_ids:
                            own.append(piece)
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (
                    pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"]
                if with_ids:
                    columns.append(pa.array(own, pa.list_(pa.uint32())).cast(pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        # the worker lives on, and what it remembers is no use to other operators
        tokenizer.clear()
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long"), whole_text("text").alias("text")).mapInArrow(
        cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"
        + ", ids array<int>" * with_ids)


# ---- the plan -----------------------------------------------------------------------------------

def _pair(free: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """The pair of available lengths with the sum ``gap`` whose longer one is longest."""
    low = np.arange(1, gap // 2 + 1)
    both = (free[low] > 0) & (free[gap - low] > 0)
    if gap % 2 == 0 and len(low) and free[gap // 2] < 2:
        both[-1] = False
    at = int(np.argmax(both)) if len(low) and both.any() else -1
    return (gap - at - 1, at + 1) if at >= 0 else None


def complement(free: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three available lengths with the sum ``gap``, as few as there are."""
    if gap < len(free) and free[gap] > 0:
        return (gap,)
    if found := _pair(free, gap):
        return found
    for a in np.flatnonzero(free[: gap - 1])[::-1].tolist():
        if 3 * a < gap:
            break
        free[a] -= 1
        rest = _pair(free, gap - a)
        free[a] += 1
        if rest:
            return (a, *rest)
    return None


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns ``(sequences, [(length, times), ...])`` that use every piece counted."""
    free = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        free[length] = n
    patterns = []
    while (left := np.flatnonzero(free)).size:
        filled, gap = [], size
        free_now = free.copy()
        while gap:
            found = complement(free_now, gap) if filled else None
            if not found:
                fits = np.flatnonzero(free_now[: gap + 1])
                if not fits.size:
                    break
                found = (int(fits[-1]) if filled else int(left[-1]),)
            for length in found:
                free_now[length] -= 1
                filled.append(length)
                gap -= length
        times = Counter(filled)
        sequences = min(int(free[x]) // n for x, n in times.items())
        for x, n in times.items():
            free[x] -= n * sequences
        patterns.append((sequences, sorted(times.items(), reverse=True)))
    return patterns


def intervals(patterns) -> np.ndarray:
    """Rows ``length, first rank, first sequence, times, offset``, sorted by length and rank."""
    used, rows, sequence = Counter(), [], 0
    for n, times in patterns:
        offset = 0
        for length, k in times:
            rows.append((length, used[length], sequence, k, offset))
            used[length] += n * k
            offset += length * k
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(found: DataFrame, size: int = SIZE) -> DataFrame:
    """``sequence_id`` and ``offset`` for written :func:`pieces`."""
    spark = found.sparkSession
    counts = cut(found.groupBy("part", "length").agg(F.count("*").alias("n")))
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(intervals(plan(totals, size)))
    before = counts.select(
        F.col("part").alias("p_part"), F.col("length").alias("p_length"),
        (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"),
    )
    ranked = found.join(
        before, (F.col("part") == F.col("p_part")) & (F.col("length") == F.col("p_length"))
    ).withColumn("rank", F.col("before") + F.col("local"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        rows = places.value
        high = np.int64(1 << 44)  # ranks stay below, lengths times this below 2 ** 63
        at = np.searchsorted(rows[:, 0] * high + rows[:, 1], (length * high + rank).to_numpy(), "right") - 1
        _, first, sequence, times, offset = rows[at].T
        turn, slot = np.divmod(rank.to_numpy() - first, times)
        return pd.DataFrame({"sequence_id": sequence + turn, "offset": offset + slot * length.to_numpy()})

    return ranked.withColumn("_at", place("length", "rank")).select(
        *[c for c in found.columns if c not in ("part", "local")], "_at.sequence_id", "_at.offset")


def pack_documents(
    docs: DataFrame, tokenizer_path: str, size: int = SIZE, id_col: str = "doc_id",
    text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """One row per piece: its document, place there, length, checksum, sequence and offset in it.

    A null text is the empty text, which is the end id alone. Null ids and repeated rows are
    documents like any other. An empty table gives no rows. Other columns are not read. ``size``
    is at most 2 ** 18.
    """
    docs = narrowed(docs, doc_id=id_col, text=text_col)
    return pack(cut(pieces(docs, tokenizer_path, size, with_ids)), size)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` of pieces packed ``with_ids``; a sequence has ``size`` ids at most."""
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"]))
        .alias("ids"))


def op7_pack(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2,048 tokens."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
