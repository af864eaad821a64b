"""Hard negatives by Fagin's threshold algorithm over cells of candidates.

Every component is an integer, so scores are exact inner products. Candidates are put in order of
label and id and cut into cells of bounded size; a cell keeps one sorted list per dimension. Each
anchor goes to the cells that can hold its partners, as a row of its own, and a task reads a cell's
candidates first and streams the anchors past them. For an anchor the lists are read in the
direction of its signs (greatest component first where the anchor's is positive, least first where
it is negative), rows seen for the first time are scored by random access, and the scan of a cell
ends once the threshold, the greatest score a row not seen yet can have, lies strictly below the
kth score of each window (or below the window's lower end). Two rounds: the anchors' positives,
whose scores fix the windows, then the negatives in these windows. The best of all cells are merged.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pickline.llm.common import narrowed, table
from pickline.operators.ordering import with_position
from pickline.session import cut

EVERY, SCALE, POSITIVES, NEGATIVES = 100, 256, 5, 10
#: A window runs from the first to the second of these shares (in percent) of the positive's score.
LOW, HIGH = 30, 90
#: Candidates in a cell: no more than the greater number, and no fewer than the smaller one just for
#: the sake of more tasks. 65,536 rows of 64 components and their lists take about 70 MB in a task.
CELL_ROWS, LEAST_ROWS = 65_536, 2_048
#: Entries read from each list in a scan's first step; every further step reads twice as many.
FIRST_DEPTH = 64
_MOST = (1 << 63) - 1


# ---- one cell -----------------------------------------------------------------------------------

class Lists:
    """Candidates ``(ids, rows of integers)`` with a sorted list per dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray):
        self.ids, self.rows, self.labels = ids, rows, labels
        self.order = np.ascontiguousarray(np.argsort(rows, axis=0, kind="stable").T)
        self.sorted = np.ascontiguousarray(np.take_along_axis(rows.T, self.order, axis=1))

    def only(self, label: int) -> Lists:
        """The candidates of one label, which lie side by side."""
        lo, hi = np.searchsorted(self.labels, [label, label], "left")[0], np.searchsorted(self.labels, label, "right")
        return Lists(self.ids[lo:hi], self.rows[lo:hi], self.labels[lo:hi])


def scores(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles while every partial sum is below 2 ** 53, else Python integers.

    ``rows`` holds doubles or Python integers. Scores beyond 64 bits are cut to its ends.
    """
    if rows.dtype != object:
        return (rows @ anchor).astype(np.int64)
    return np.array([max(-_MOST, min(_MOST, sum(x * y for x, y in zip(r, anchor, strict=True)))) for r in rows],
                    np.int64).reshape(len(rows))


class Window:
    """The best ``k`` ``(score, id)`` with ``low <= score <= high``, greatest score and least id first."""

    def __init__(self, k: int, low: int = -_MOST, high: int = _MOST):
        self.k, self.low, self.high = k, low, high
        self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        fits = (score >= max(self.low, self.score[-1] if len(self.score) == self.k else self.low)) & (score <= self.high)
        if fits.any():
            score, ids = np.concatenate([self.score, score[fits]]), np.concatenate([self.id, ids[fits]])
            best = np.lexsort((ids, -score))[: self.k]
            self.score, self.id = score[best], ids[best]

    def settled(self, threshold: int) -> bool:
        """Whether no row with at most this score can enter; an equal score still could, by its id."""
        return self.low > self.high or threshold < self.low or (
            len(self.score) == self.k and threshold < self.score[-1])


def scan(lists: Lists, anchor: np.ndarray, windows: list[Window], skip_id: int | None = None,
         skip_label: int | None = None) -> int:
    """Fill the windows from a cell; returns how many candidates were scored."""
    n = len(lists.ids)
    used = np.flatnonzero(anchor != 0)
    up = (anchor[used] > 0)[:, None]
    seen = np.zeros(n, bool)
    depth, step = 0, FIRST_DEPTH
    while depth < n:
        if not len(used):  # every score is 0: nothing is ordered by any list
            fresh = np.arange(n)
            depth = n
        else:
            span = np.arange(depth, min(n, depth + step))
            rank = np.where(up, n - 1 - span, span)
            found = np.zeros(n, bool)
            found[lists.order[used[:, None], rank]] = True
            fresh = np.flatnonzero(found & ~seen)
            depth, step = depth + len(span), 2 * step
        seen[fresh] = True
        if skip_label is not None:
            fresh = fresh[lists.labels[fresh] != skip_label]
        if skip_id is not None:
            fresh = fresh[lists.ids[fresh] != skip_id]
        score = scores(lists.rows[fresh], anchor)
        for window in windows:
            window.add(score, lists.ids[fresh])
        if depth < n:
            # what a row not seen yet can score at most: the next entry of every list
            edge = lists.sorted[used, np.where(up[:, 0], n - 1 - depth, depth)]
            threshold = int(scores(edge[None, :], anchor[used])[0])
            if all(w.settled(threshold) for w in windows):
                break
    return int(seen.sum())


def _matrix(vectors, width: int) -> np.ndarray:
    """An Arrow list array as rows of doubles, shorter vectors ended with zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    edges = vectors.offsets.to_numpy()
    lengths = np.diff(edges)
    if len(lengths) and (lengths == width).all():
        whole = flat.reshape(-1, width)
    else:
        whole = np.zeros((len(lengths), width), np.int64)
        at = np.repeat(np.arange(len(lengths)), lengths)
        whole[at, np.arange(len(flat)) - np.repeat(edges[:-1] - edges[0], lengths)] = flat
    return whole


def _exact(rows: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if all sums are exact in doubles, else as Python integers."""
    most = [int(np.abs(x.astype(object)).max()) if x.size and np.abs(x, dtype=np.float64).max() >= 2**62
            else int(np.abs(x).max()) if x.size else 0 for x in (rows, anchors)]
    exact = max(1, rows.shape[1]) * max(1, most[0]) * max(1, most[1]) < 1 << 53
    kind = np.float64 if exact else object
    return rows.astype(kind), anchors.astype(kind)


# ---- Spark --------------------------------------------------------------------------------------

def candidates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
               label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """``(id, label, v)`` of the rows that take part, ``v`` as whole numbers ``floor(scale * x)``.

    Rows with a null id, label or vector, or a component that is null or not finite, take no part.
    Components beyond 64 bits are cut to its ends. Rows of one id count as one row: that with the
    least label, then the least vector.
    """
    own = narrowed(vectors, id=id_col, label=label_col, v=vector_col).select(
        F.col("id").cast("long"), F.col("label").cast("long"), F.col("v").cast("array<double>"))
    sound = F.forall("v", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return (
        own.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
        .filter(sound)
        .select("id", F.struct("label", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("v")).alias("s"))
        .groupBy("id").agg(F.min("s").alias("s"))
        .select("id", "s.label", "s.v")
    )


def _celled(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows with their ``cell``, neighbours in the order of label and id, and the number of cells."""
    n = rows.count()
    wanted = 2 * rows.sparkSession.sparkContext.defaultParallelism
    cells = max(1, -(-n // CELL_ROWS), min(wanted, -(-n // LEAST_ROWS)))
    size = max(1, -(-n // cells))
    placed = with_position(rows, F.col("label").asc(), F.col("id").asc(), name="at")
    return cut(placed.withColumn("cell", F.expr(f"cast(at div {size} as int)")).drop("at")), cells


def _scanned(celled: DataFrame, cells: int, anchors: DataFrame, goes: str, run, schema: str) -> DataFrame:
    """``run(lists, anchors of a batch)`` for the cells that each anchor goes to.

    ``goes`` is a condition on ``label`` (the anchor's) and a cell's least and greatest label, ``lo``
    and ``hi``. There is one broadcast row of these for thousands of candidates; an anchor is copied
    to each of its cells, which is what a query set against all rows takes.
    """
    ranges = celled.groupBy("cell").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    copies = anchors.join(F.broadcast(ranges), F.expr(goes))
    extra = [c for c in anchors.columns if c not in ("id", "label", "v")]
    both = copies.select("cell", F.lit(True).alias("anchor"), "id", "label", "v", *extra).unionByName(
        celled.withColumn("anchor", F.lit(False)), allowMissingColumns=True)

    def read(batches):
        cell, held, lists = None, [], None
        for batch in batches:
            edges = np.flatnonzero(np.diff(batch["cell"].to_numpy())) + 1
            for lo, hi in zip([0, *edges], [*edges, len(batch)], strict=True):
                part = batch.slice(lo, hi - lo)
                if part["cell"][0].as_py() != cell:
                    cell, held, lists = part["cell"][0].as_py(), [], None
                first = int(np.searchsorted(part["anchor"].to_numpy(zero_copy_only=False), True))
                if first:
                    held.append(part.slice(0, first))
                if first < len(part):
                    if lists is None:
                        lists = _held(held)
                    yield from run(lists, part.slice(first))

    return both.repartitionById(cells, "cell").sortWithinPartitions("cell", "anchor", "label", "id").mapInArrow(read, schema)


def _held(parts) -> Lists | None:
    import pyarrow as pa

    if not parts:
        return None
    whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    width = int(np.diff(whole["v"].offsets.to_numpy()).max())
    return Lists(whole["id"].to_numpy(), _matrix(whole["v"], width), whole["label"].to_numpy())


def _vectors(lists: Lists, part) -> tuple[Lists, np.ndarray]:
    """The lists and a batch's anchors in equal width and in numbers that keep scores exact."""
    width = max(lists.rows.shape[1], int(np.diff(part["v"].offsets.to_numpy()).max()))
    anchors = _matrix(part["v"], width)
    if width > lists.rows.shape[1]:
        more = np.zeros((len(lists.ids), width - lists.rows.shape[1]), lists.rows.dtype)
        lists = Lists(lists.ids, np.hstack([lists.rows, more]), lists.labels)
    rows, anchors = _exact(lists.rows, anchors)
    exact = object.__new__(Lists)
    exact.__dict__.update(lists.__dict__, rows=rows, sorted=lists.sorted.astype(rows.dtype))
    return exact, anchors


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each key by score and id, with their rank."""
    order = W.partitionBy(*keys).orderBy(F.col("score").desc(), "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def positives(celled: DataFrame, cells: int, anchors: DataFrame, k: int = POSITIVES) -> DataFrame:
    """``(id, other, score, rank)``: the first ``k`` other rows of an anchor's label."""

    def run(lists, part):
        import pyarrow as pa

        if lists is None:
            return
        lists, vectors = _vectors(lists, part)
        label, own = None, None
        out = []
        for anchor_id, anchor_label, v in zip(part["id"].to_pylist(), part["label"].to_pylist(), vectors, strict=True):
            if anchor_label != label:
                label, own = anchor_label, lists.only(anchor_label)
            window = Window(k)
            scan(own, v, [window], skip_id=anchor_id)
            out += [(anchor_id, o, s) for o, s in zip(window.id.tolist(), window.score.tolist(), strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)],
                                             ["id", "other", "score"])

    found = _scanned(celled, cells, anchors, "lo <= label and label <= hi", run,
                     "id long, other long, score long")
    return _best(found, ["id"], k)


def bounds(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and greatest whole number between two shares, in percent, of a score."""
    return -(-low * score // 100), high * score // 100


def negatives(celled: DataFrame, cells: int, anchors: DataFrame, k: int = NEGATIVES, low: int = LOW,
              high: int = HIGH) -> DataFrame:
    """``(id, positive, other, score, rank)`` for anchors with an array ``positives`` of (id, score)."""

    def run(lists, part):
        import pyarrow as pa

        if lists is None:
            return
        lists, vectors = _vectors(lists, part)
        out = []
        for anchor_id, label, mine, v in zip(part["id"].to_pylist(), part["label"].to_pylist(),
                                             part["positives"].to_pylist(), vectors, strict=True):
            windows = [Window(k, *bounds(p["score"], low, high)) for p in mine]
            scan(lists, v, windows, skip_label=label)
            for p, w in zip(mine, windows, strict=True):
                out += [(anchor_id, p["other"], p["score"], o, s)
                        for o, s in zip(w.id.tolist(), w.score.tolist(), strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)],
                                             ["id", "positive", "positive_score", "other", "score"])

    found = _scanned(celled, cells, anchors, "lo <> label or hi <> label", run,
                     "id long, positive long, positive_score long, other long, score long")
    return _best(found, ["id", "positive"], k)


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    every: int = EVERY, scale: int = SCALE, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows with an id divisible by ``every``. Higher scores come first, equal ones by
    the smaller id. Which rows take part, and what repeated ids mean, is told at
    :func:`candidates`. Vectors of different lengths are compared as if the shorter one ended in
    zeros; an empty one scores 0 with all. Scores beyond 64 bits are cut to its ends. An anchor
    without positives, or a positive without a row in its window, gives no rows; nor does an empty
    table. Other columns are not read.
    """
    celled, cells = _celled(cut(candidates(vectors, id_col, vector_col, label_col, scale)))
    anchors = celled.filter(F.col("id") % every == 0).drop("cell")
    near = cut(positives(celled, cells, anchors, n_positives).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "other", "score"))).alias("positives")))
    found = negatives(celled, cells, anchors.join(near, "id"), n_negatives, low, high)
    return found.select(
        F.col("id").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank",
        F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(vectors: DataFrame) -> DataFrame:
    """The query's labels: ``(label + 1) % 10`` where the id is divisible by 7."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return vectors.withColumn("label", moved)


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all vectors."""
    return hard_negatives(relabelled(table(spark, sf_dir, "embeddings")))


OP11_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 10
"""
