"""Exact n-gram Jaccard self-join with signature trees.

1. Texts become sets of shingle hashes; texts with equal sets are one set from then on.
2. A set's shingles have a global order: rare ones by hash, then those that mergeable
   Misra-Gries summaries call frequent. Two sets that are similar enough share some shingles of
   their prefixes, at least ``least_shared`` of them. Sets are gathered into cells so that every
   such pair lies in one cell: first along the least set, then the least cell, of each shared
   shingle, then between any cells that still share shingles. Cells may be too coarse, never too fine.
3. Each cell is joined by a signature tree: nodes hold OR-combined bitmaps and size ranges, and the
   traversal of node pairs drops those whose largest possible overlap is too small, and those
   already in one component. Pairs that are left are compared exactly. A cell heavier than
   ``CELL_SHINGLES`` is cut by size into blocks and joined block pair by block pair.

Every text is sent to its cell once (a heavy cell's to its block pairs); no pair is ever a row of a
table except pairs of cells that share a shingle, and of those a shingle gives at most
half of ``SMALL_LIST`` squared; a longer list of cells becomes one cell.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pickline.llm.common import narrowed, table, whole_text
from pickline.llm.shingles import set_ids, shingle_sets, slices
from pickline.operators.groups import component_roots
from pickline.operators.merges import split_by_filter
from pickline.session import cut

WORDS = 5
PERCENT = 75
#: Counters of a task's summary of frequent shingles, and of the shingles ordered last.
COUNTERS, FREQUENT, FREQUENT_FROM = 65_536, 65_536, 32
#: Cells of one shingle that are paired; more are joined to one cell.
SMALL_LIST = 128
#: Cells of one shingle that are always paired; see ``_listed`` for those of longer lists.
SHORT_LIST = 8
#: Rounds in which sets, then cells, are gathered along the least one of each shared shingle.
STAR_ROUNDS = 2
#: Shingles of all sets that one task joins.
CELL_SHINGLES = 2_000_000
LEAF = 16


def least_shared(n):
    """How many shingles of its prefix a set of ``n`` shares at least with any similar one.

    More means longer prefixes and fewer cells of sets that only share a passage.
    """
    return 1 + np.maximum(n // 32, np.minimum(n // 4, 10))


def least_shared_sql(n: str) -> str:
    """The same in SQL."""
    return f"1 + greatest(floor({n} / 32), least(floor({n} / 4), 10))"


def prefix_length(n, percent: int = PERCENT):
    """Two sets with ``percent`` similarity share ``least_shared`` of so many first shingles.

    Similar sets have at least ``percent`` of the larger one's shingles in common. Were fewer than
    that shared in both prefixes, the rest of the set whose prefix ends first could not hold the
    others.
    """
    return np.minimum(n, n - -(-percent * n // 100) + least_shared(n))


# ---- one cell -----------------------------------------------------------------------------------

class SignatureTree:
    """Nodes over sets sorted by size: OR-combined bitmaps, size ranges and lost bits."""

    def __init__(self, sets: list[np.ndarray], members: np.ndarray, bits: int):
        sizes = np.array([len(sets[i]) for i in members])
        low = np.array([sets[i][0] if len(sets[i]) else 0 for i in members], np.uint64)
        order = np.lexsort((low, sizes))
        self.members, self.sizes = members[order], sizes[order]
        self.maps = np.zeros((len(members), bits // 64), np.uint64)
        for row, i in enumerate(self.members):
            at = (sets[i] % np.uint64(bits)).astype(np.int64)
            np.bitwise_or.at(self.maps[row], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        self.lost = self.sizes - np.bitwise_count(self.maps).sum(1, dtype=np.int64)
        self.root = self._node(0, len(members))

    def _node(self, lo: int, hi: int):
        own = (lo, hi, np.bitwise_or.reduce(self.maps[lo:hi]), int(self.sizes[lo]),
               int(self.sizes[hi - 1]), int(self.lost[lo:hi].max()))
        if hi - lo <= LEAF:
            return own, ()
        step = -(-(hi - lo) // 4)
        step = max(LEAF, -(-step // LEAF) * LEAF)
        return own, tuple(self._node(i, min(i + step, hi)) for i in range(lo, hi, step))


def tree_components(sets: list[np.ndarray], side: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """For each set the least position it is linked with, over links of similar sets.

    ``side`` splits the sets in two blocks, of which only pairs across are looked at; with one
    block all pairs are.
    """
    root = np.arange(len(sets))
    bits = 256
    while bits < 2 * max(map(len, sets)) and bits < 1 << 15:
        bits *= 2
    sides = [np.flatnonzero(side == s) for s in np.unique(side)]
    trees = [SignatureTree(sets, members, bits) for members in sides]
    one, two = trees[0], trees[-1]
    stack = [(one.root, two.root)]
    while stack:
        (a, below_a), (b, below_b) = stack.pop()
        lo_a, hi_a, map_a, min_a, max_a, lost_a = a
        lo_b, hi_b, map_b, min_b, max_b, lost_b = b
        if 100 * max_a < percent * min_b or 100 * max_b < percent * min_a:
            continue
        possible = int(np.bitwise_count(map_a & map_b).sum(dtype=np.int64)) + min(lost_a, lost_b)
        if (100 + percent) * possible < percent * (min_a + min_b):
            continue
        mine, other = one.members[lo_a:hi_a], two.members[lo_b:hi_b]
        first = root[mine[0]]
        if (root[mine] == first).all() and (root[other] == first).all():
            continue
        same = one is two and lo_a == lo_b and hi_a == hi_b
        if same and below_a:
            stack += [(x, y) for i, x in enumerate(below_a) for y in below_a[i:]]
        elif below_a and (hi_a - lo_a >= hi_b - lo_b or not below_b):
            stack += [(x, (b, below_b)) for x in below_a]
        elif below_b:
            stack += [((a, below_a), y) for y in below_b]
        else:
            common = np.bitwise_count(one.maps[lo_a:hi_a, None] & two.maps[None, lo_b:hi_b]).sum(
                2, dtype=np.int64)
            most = common + np.minimum(one.lost[lo_a:hi_a, None], two.lost[None, lo_b:hi_b])
            both = one.sizes[lo_a:hi_a, None] + two.sizes[None, lo_b:hi_b]
            maybe = (100 + percent) * most >= percent * both
            maybe &= root[mine][:, None] != root[other][None]
            if same:
                maybe &= np.triu(np.ones(maybe.shape, bool), 1)
            for i, j in zip(*np.nonzero(maybe), strict=True):
                x, y = int(mine[i]), int(other[j])
                if root[x] != root[y]:
                    shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if (100 + percent) * shared >= percent * (len(sets[x]) + len(sets[y])):
                        keep, gone = sorted((root[x], root[y]))
                        root[root == gone] = keep
    return root


# ---- steps --------------------------------------------------------------------------------------

def _by_slice(texts, words: int):
    for i, j in slices(texts):
        yield i, j, *shingle_sets(texts.slice(i, j - i), words)


def _tighten(keys: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A Misra-Gries summary of a summary: all counters less the first that has no room."""
    if len(keys) <= most:
        return keys, counts
    less = np.partition(counts, len(counts) - most - 1)[len(counts) - most - 1]
    kept = counts > less
    return keys[kept], counts[kept] - less


def _sized(docs: DataFrame, words: int) -> DataFrame:
    """Rows ``(doc_id, th, rid, n)`` of all documents, and ``(null, null, h, count)`` of summaries."""

    def read(batches):
        import pyarrow as pa

        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        names = ["doc_id", "th", "rid", "n", "counter"]
        for batch in batches:
            parts = [keys]
            for i, j, hashes, ends in _by_slice(batch["text"], words):
                parts.append(hashes)
                sizes = np.diff(ends, prepend=0)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(i, j - i), batch["th"].slice(i, j - i),
                     pa.array(set_ids(hashes, ends)), pa.array(sizes, pa.int64()),
                     pa.array(np.zeros(j - i, bool))], names)
            k, c = np.unique(np.concatenate(parts), return_counts=True)
            c[np.searchsorted(k, keys)] += counts - 1
            keys, counts = _tighten(k, c, COUNTERS)
        none = pa.nulls(len(keys), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, pa.array(keys.view(np.int64)), pa.array(counts), pa.array(np.ones(len(keys), bool))],
            names)

    return docs.mapInArrow(read, "doc_id long, th long, rid long, n long, counter boolean")


def _entries(docs: DataFrame, frequent, words: int, percent: int) -> DataFrame:
    """``(h, rid, n)`` for the prefix of every set, once a task for equal sets."""

    def read(batches):
        import pyarrow as pa

        last, seen = frequent.value, set()
        for batch in batches:
            for _, _, hashes, ends in _by_slice(batch["text"], words):
                ids, sizes = set_ids(hashes, ends), np.diff(ends, prepend=0)
                fresh = np.zeros(len(ids), bool)
                for k, (rid, n) in enumerate(zip(ids.tolist(), sizes.tolist(), strict=True)):
                    if n and rid not in seen:
                        seen.add(rid)
                        fresh[k] = True
                doc = np.repeat(np.arange(len(ids)), sizes)
                at = np.minimum(np.searchsorted(last, hashes), max(len(last) - 1, 0))
                late = (last[at] == hashes) if len(last) else np.zeros(len(hashes), bool)
                late_before = np.concatenate([[0], np.cumsum(late)])
                starts = ends - sizes
                late_here = late_before[:-1] - late_before[starts][doc]
                place = np.arange(len(hashes)) - starts[doc]
                late_all = late_before[ends] - late_before[starts]
                rank = np.where(late, (sizes - late_all)[doc] + late_here, place - late_here)
                kept = (rank < prefix_length(sizes, percent)[doc]) & fresh[doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[kept].view(np.int64)), pa.array(ids[doc[kept]]),
                     pa.array(sizes[doc[kept]], pa.int32())], ["h", "rid", "n"])

    return docs.select("text").mapInArrow(read, "h long, rid long, n int")


def _shared(entries: DataFrame) -> DataFrame:
    """Entries whose shingle another set has too, with the least set of that shingle as centre.

    ``rid`` is a set or a cell; rows of one shingle and ``rid`` become one, from the least ``n`` to the
    most ``m`` of them. Reads each task's entries in the order of shingle and set and holds one row of
    state, so that a shingle of any number of sets passes through.
    """

    def read(batches):
        import pyarrow as pa

        names = ["h", "rid", "n", "m", "centre", "c_n", "c_m"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        held = None  # the last row: it is decided by the one after it
        centre = (0, 0, 0)
        for batch in batches:
            h, rid, n, m = (batch[c].to_numpy(zero_copy_only=False) for c in names[:4])
            if held is not None:
                h, rid, n, m = (np.concatenate([[x], y]) for x, y in zip(held[:4], (h, rid, n, m), strict=True))
            if not len(h):
                continue
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (rid[1:] != rid[:-1])
            at = np.flatnonzero(new)
            h, rid, n, m = h[at], rid[at], np.minimum.reduceat(n, at), np.maximum.reduceat(m, at)
            open_before = held is not None and held[4]
            begins = np.ones(len(h), bool)
            begins[1:] = h[1:] != h[:-1]
            first = np.maximum.accumulate(np.where(begins, np.arange(len(h)), 0))
            own = rid[first], n[first], m[first]
            if open_before:  # the held row continues a list whose first row has passed
                own = tuple(np.where(first == 0, x, y) for x, y in zip(centre, own, strict=True))
            follows = ~begins
            if open_before:
                follows[0] = True
            followed = np.append(h[1:] == h[:-1], False)
            out = (follows | followed)[:-1]
            held = (h[-1], rid[-1], n[-1], m[-1], bool(follows[-1]))
            centre = tuple(x[-1] for x in own)
            if out.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[:-1][out], k) for x, k in zip((h, rid, n, m, *own), kinds, strict=True)], names)
        if held is not None and held[4]:
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], k) for x, k in zip((*held[:4], *centre), kinds, strict=True)], names)

    return entries.repartition("h").sortWithinPartitions("h", "rid").mapInArrow(
        read, "h long, rid long, n int, m int, centre long, c_n int, c_m int")


def _listed(lists: DataFrame, percent: int) -> DataFrame:
    """``(h, rid, n, m, slack)``: the cells of every shingle that have to be paired.

    Two cells with similar sets share as many shingles as the smallest set that may be similar to one
    of theirs must share, the ``bound`` of a cell. A cell with fewer shingles than its bound has no
    partner. ``slack`` is how many of a cell's shingles have long lists, of more than ``SHORT_LIST``
    cells. Where that is less than the bound, any partner shares a shingle with a short list, so
    that the cell is left out of the long ones. Else shingles that texts have in common by chance
    would make as many pairs as the square of the number of these texts.
    """
    def in_lists(rows: DataFrame) -> DataFrame:
        return cut(rows.withColumn("cells", F.count("*").over(W.partitionBy("h"))).filter("cells > 1"))

    bound = F.expr(least_shared_sql(f"floor({percent} * least / 100)"))
    listed = in_lists(
        lists.repartition("h").groupBy("h", "rid").agg(F.min("n").alias("n"), F.max("m").alias("m")))
    enough = listed.groupBy("rid").agg(F.count("*").alias("c"), F.min("n").alias("least")).filter(F.col("c") >= bound)
    listed = in_lists(listed.drop("cells").join(enough.select("rid"), "rid").repartition("h"))
    long = F.col("cells") > SHORT_LIST
    slack = listed.groupBy("rid").agg(F.count_if(long).alias("slack"), F.min("n").alias("least"))
    return listed.join(slack, "rid").filter(~long | (F.col("slack") >= bound)).select("h", "rid", "n", "m", "slack")


def _cell_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """``(lo, hi, need)`` for cells ``rid`` that share a shingle, read in the order ``(h, rid)``.

    ``need`` is how many of these rows the two must have at least to matter, 0 if they must be joined
    whatever else they share: the shingles of long lists may be left out.
    """

    def read(batches):
        import pandas as pd

        open_h, cells, chained = None, [], None  # cells: [cell, least n, most n, least shared, slack]

        def close():
            out = []
            for i, (x, lo_x, hi_x, s_x, slack_x) in enumerate(cells):
                for y, lo_y, hi_y, s_y, slack_y in cells[i + 1 :]:
                    if 100 * hi_x >= percent * lo_y and 100 * hi_y >= percent * lo_x:
                        out.append((x, y, max(1, min(s_x, s_y) - min(slack_x, slack_y))))
            return out

        for batch in batches:
            out = []
            for h, cell, n, m, slack in zip(
                    *(batch[c].to_pylist() for c in ("h", "rid", "n", "m", "slack")), strict=True):
                if h != open_h:
                    out += close() if chained is None else []
                    open_h, cells, chained = h, [], None
                if chained is not None:
                    out.append((chained, cell, 0))
                else:
                    cells.append((cell, n, m, int(least_shared(n)), slack))
                    if len(cells) > SMALL_LIST:
                        chained = cells[0][0]
                        out += [(chained, x[0], 0) for x in cells[1:]]
            if out:
                yield _pairs_frame(pd, out)
        if chained is None and (out := close()):
            yield _pairs_frame(pd, out)

    def _pairs_frame(pd, out):
        import pyarrow as pa

        lo, hi, need = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(need, pa.int32())], ["lo", "hi", "need"])

    return lists.repartition("h").sortWithinPartitions("h", "rid").mapInArrow(
        read, "lo long, hi long, need int")


def _joined(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """``(rid, root)`` for linked sets of each task key; ``rows(key, side, rid, text)``."""

    def read(batches):
        import pyarrow as pa

        key, sides, rids, sets = None, [], [], []

        def close():
            found = tree_components(sets, np.array(sides), percent) if len(sets) > 1 else []
            return [(rids[i], rids[r]) for i, r in enumerate(found) if i != r]

        for batch in batches:
            out = []
            for i, j, hashes, ends in _by_slice(batch["text"], words):
                ids, begin = set_ids(hashes, ends).tolist(), 0
                keys, side, rid = (batch[c].slice(i, j - i).to_pylist() for c in ("key", "side", "rid"))
                for k, end in enumerate(ends.tolist()):
                    if keys[k] != key:
                        out += close()
                        key, sides, rids, sets = keys[k], [], [], []
                    if ids[k] == rid[k]:  # not another text of the same id
                        if not (rids and rids[-1] == rid[k] and sides[-1] == side[k]):
                            sides.append(side[k])
                            rids.append(rid[k])
                            sets.append(hashes[begin:end].copy())
                    begin = end
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["rid", "root"])
        if out := close():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["rid", "root"])

    return rows.repartition("key").sortWithinPartitions("key", "side", "rid").select(
        "key", "side", "rid", "text").mapInArrow(read, "rid long, root long")


def _cells(entries: DataFrame, percent: int) -> DataFrame:
    """``(rid, cell)`` for sets that may be similar to another; see the module's text."""
    lists, levels = entries.withColumn("m", F.col("n")), []
    for _ in range(STAR_ROUNDS):
        shared = cut(_shared(lists))
        stars = (
            shared.filter("rid != centre")
            .filter((100 * F.col("m") >= percent * F.col("c_n")) & (100 * F.col("c_m") >= percent * F.col("n")))
            .groupBy("rid", "centre")
            .agg(F.count("*").alias("c"), F.least(F.min("n"), F.min("c_n")).alias("n"))
            .filter(f"c >= {least_shared_sql('n')}")
            .select(F.greatest("rid", "centre").alias("hi"), F.least("rid", "centre").alias("lo"))
        )
        levels.append(cut(component_roots(stars)))
        lists = shared.join(levels[-1].withColumnRenamed("v", "rid"), "rid", "left").select(
            "h", F.coalesce("root", "rid").alias("rid"), "n", "m")
    pairs = (
        _cell_pairs(_listed(lists, percent), percent).groupBy("lo", "hi")
        .agg(F.count("*").alias("c"), F.min("need").alias("need")).filter("c >= need")
        .select(F.greatest("lo", "hi").alias("hi"), F.least("lo", "hi").alias("lo"))
    )
    levels.append(cut(component_roots(pairs)))
    found = levels[0].select(F.col("v").alias("rid"), F.col("root").alias("cell"))
    for level in levels[1:]:
        new = level.select(F.col("v").alias("cell"), F.col("root").alias("top"))
        lone = new.select(F.col("cell").alias("rid"), "cell").join(found.select("rid"), "rid", "left_anti")
        found = cut(found.unionByName(lone).join(new, "cell", "left").select(
            "rid", F.coalesce("top", "cell").alias("cell")))
    return found


def _tasks(cells: DataFrame, cell_shingles: int, percent: int = PERCENT) -> DataFrame:
    """``(rid, ..., key, side)``: every set in its cell's task, or in those of its block's pairs.

    ``cells`` has ``(rid, n, cell)``. A cell's weight by size tells the blocks, so that no task has
    to see a cell whole to cut it.
    """
    half = max(1, cell_shingles // 2)
    weights = cells.groupBy("cell", "n").agg(F.sum("n").alias("w"))
    up_to = W.partitionBy("cell").orderBy("n")
    levels = weights.withColumn("total", F.sum("w").over(W.partitionBy("cell"))).withColumn(
        "block", F.floor((F.sum("w").over(up_to) - F.col("w")) / half))
    levels = levels.withColumn("block", F.when(F.col("total") <= cell_shingles, 0).otherwise(F.col("block"))) \
        .withColumn("parts", F.when(F.col("total") <= cell_shingles, 1).otherwise(F.ceil(F.col("w") / half)))
    levels = cut(levels)
    placed = cells.join(levels.select("cell", "n", "block", "parts", "total"), ["cell", "n"]).withColumn(
        "block", F.col("block") * 100_000 + F.pmod(F.xxhash64("rid"), F.col("parts")) * (F.col("parts") > 1).cast("int"))
    light = placed.filter(F.col("total") <= cell_shingles).select(
        "rid", "doc_id", "th", F.xxhash64("cell").alias("key"), F.col("cell").alias("task"), F.lit(0).alias("side"))
    heavy = levels.filter(F.col("total") > cell_shingles)
    if heavy.isEmpty():
        return light
    blocks = cut(
        placed.filter(F.col("total") > cell_shingles).groupBy("cell", "block")
        .agg(F.min("n").alias("lo"), F.max("n").alias("hi")))
    x, y = blocks.alias("x"), blocks.alias("y")
    pairs = x.join(y, (F.col("x.cell") == F.col("y.cell")) & (F.col("x.block") <= F.col("y.block"))
                   & (100 * F.col("x.hi") >= percent * F.col("y.lo")) & (100 * F.col("y.hi") >= percent * F.col("x.lo")))
    pairs = pairs.select(F.col("x.cell").alias("cell"), F.col("x.block").alias("one"), F.col("y.block").alias("two"),
                         F.xxhash64("x.cell", "x.block", "y.block").alias("key"))
    sides = cut(
        pairs.select("cell", F.col("one").alias("block"), "key", F.lit(0).alias("side")).unionByName(
            pairs.filter("one != two").select("cell", F.col("two").alias("block"), "key", F.lit(1).alias("side"))))
    return light.unionByName(
        placed.filter(F.col("total") > cell_shingles).join(sides, ["cell", "block"])
        .select("rid", "doc_id", "th", "key", F.col("cell").alias("task"), "side"))


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
    percent: int = PERCENT, cell_shingles: int = CELL_SHINGLES, hashes: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, n_shingles, component_id)``, and the text's hash ``th``.

    Words are what ASCII white space separates, A-Z lower-cased; a text's set is its distinct
    shingles of ``words`` words, or its whole sequence if it has fewer. Texts link when the sets'
    intersection is ``percent`` of their union or more, and ``component_id`` is the smallest id
    reachable over links, of any length. A null or empty text has an empty set and links with
    nothing. A null id counts as no id: a component of such rows alone has a null ``component_id``.
    Repeated rows link like any equal texts. An empty table gives no rows; other columns are not
    read. ``percent`` is at least 50.
    """
    spark = docs.sparkSession
    docs = narrowed(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long"), whole_text("text").alias("text")).withColumn("th", F.xxhash64("text"))
    sized = cut(_sized(docs, words))
    rows = sized.filter("not counter").drop("counter")
    often = (
        sized.filter("counter").groupBy("rid").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT_FROM)
        .orderBy(F.desc("n"), "rid").limit(FREQUENT).select("rid").collect()
    )
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r.rid for r in often], np.int64).view(np.uint64)))
    cells = cut(_cells(_entries(docs, frequent, words, percent), percent))
    sets = cut(
        rows.filter("n > 0").groupBy("rid").agg(
            F.min("doc_id").alias("least"), F.first("n").alias("n"), F.min(F.struct("doc_id", "th")).alias("one")))
    tasks = cut(_tasks(sets.join(cells, "rid").select("rid", "n", "one.doc_id", "one.th", "cell"), cell_shingles, percent))
    # merged by sorting at every size: a broadcast of what grows with the input is no saving; texts
    # that the filter of the wanted ones leaves out are not shuffled
    wanted, _ = split_by_filter(
        docs.withColumn("key", _text_key("doc_id", "th")), tasks.select(_text_key("doc_id", "th").alias("key")), "key")
    texts = wanted.drop("key").hint("merge").join(
        tasks.withColumnsRenamed({"doc_id": "t_id", "th": "t_th"}),
        F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("th") == F.col("t_th")))
    links = cut(_joined(texts, words, percent))
    if cells_split(tasks):  # links of a cell come from several tasks
        roots = component_roots(links.select(F.greatest("rid", "root").alias("hi"), F.least("rid", "root").alias("lo")))
        links = cut(roots.select(F.col("v").alias("rid"), "root"))
    known = sets.join(links, "rid", "left").select("rid", "least", F.coalesce("root", "rid").alias("root"))
    tops = known.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = cut(known.join(tops, "root").select(F.col("rid").alias("c_rid"), "component_id"))
    found = rows.filter("n > 0").join(classes, F.col("rid") == F.col("c_rid")).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "th"
    ).unionByName(rows.filter("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "th"))
    return found if hashes else found.drop("th")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with the document of the smallest id of each group of similar ones.

    Rows equal in id and text are one document; rows without an id stay unless they are similar to
    one with an id. All columns come as they came.
    """
    groups = cut(similar_groups(docs, id_col, text_col, hashes=True, **settings))
    # documents that go or come more than once; only rows that may be among them are shuffled
    touched = cut(
        groups.groupBy("doc_id", "th").agg(
            F.count("*").alias("n"), F.bool_or(~F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("gone"))
        .filter("gone or n > 1").select("doc_id", "th", "gone", _text_key("doc_id", "th").alias("_key")))
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(f"`{id_col}`").cast("long").alias("_id"), F.xxhash64(whole_text(f"`{text_col}`")).alias("_th"))
    near, rest = split_by_filter(packed.withColumn("_key", _text_key("_id", "_th")), touched, "_key")
    near = near.hint("merge").join(
        touched.filter("gone"), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_th") == F.col("th")), "left_anti")
    return near.dropDuplicates(["_id", "_th"]).unionByName(rest).select("_row.*")


def _text_key(doc_id: str, th: str) -> Column:
    """One number for an id and a text's hash, either of which may be null."""
    return F.xxhash64(doc_id, th)


def cells_split(tasks: DataFrame) -> bool:
    """Whether any cell has more than one task."""
    return not tasks.filter("key != xxhash64(task)").isEmpty()


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document with the smallest document it is linked with by five-word shingles."""
    return similar_groups(table(spark, sf_dir, "documents"))
