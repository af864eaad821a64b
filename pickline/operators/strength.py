"""Bradley-Terry strengths, their ranks, and merging them into the score table."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pickline.operators.compare import item_totals, outcomes_by_pair, split_outcomes
from pickline.operators.merges import merge_upsert
from pickline.operators.ordering import BLOCK_ROWS, carried_scan, segments, with_position
from pickline.operators.skew import BROADCAST_ROWS, HOT_ROWS, slots_of
from pickline.session import cut

# Floor of a strength, and how close strengths share a rank.
FLOOR = 1e-12
REL_TOL = 1e-9
ABS_TOL = 1e-12
#: Items of a block, whose strengths are one packed array of 1 MB.
STRENGTHS_PER_BLOCK = 131_072
#: Pairs (of both sides) that a row of packed pairs is closed at, and those of a task that lays them out.
PAIRS_PER_ROW, PAIRS_PER_TASK = 262_144, 1_048_576
#: Packed state of a fit, and the rows of its grid.
BLOCK = "block int, wins binary, s binary, before binary"
CELL_FIELDS = "block int, other int, at binary, by binary, n binary"
CELL = pa.schema([("block", pa.int32()), ("other", pa.int32()), ("at", pa.binary()), ("by", pa.binary()),
                  ("n", pa.binary())])
LOAD = pa.schema([("block", pa.int32()), ("load", pa.binary())])


def _grid(by_pair: DataFrame, items: DataFrame, pairs: int, n: int, broadcast_rows: int) -> DataFrame:
    """Pairs as cells ``(block, other, at, by, n)`` of packed arrays, one row per stretch of pairs.

    A pair is stored for both sides. Rows are ordered by the block of the side that gets the share,
    so that a task meets few blocks; a cell with many pairs is several rows in several tasks. An item
    that meets very many others is joined in slots, chosen by the opponent.
    """
    def placed(side: str, other: str, rows: DataFrame) -> DataFrame:
        named = items.select(F.col("item").alias(side), F.struct("block", "at").alias(f"_{side}"), "slots")
        if n <= broadcast_rows:
            return rows.join(F.broadcast(named.drop("slots")), side)
        # at most 2 E / hot_rows items have more than one slot
        hot = named.filter("slots > 1").select(side, F.col("slots").alias("_many"))
        slot = F.coalesce(F.pmod(F.xxhash64(other), "_many"), F.lit(0)).cast("int")
        spread = named.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).drop("slots")
        return rows.join(F.broadcast(hot), side, "left").withColumn("_slot", slot).drop("_many").join(
            spread, [side, "_slot"]).drop("_slot")

    both = placed("j", "i", placed("i", "j", by_pair.select("i", "j", "n"))).select(F.explode(F.array(
        F.struct(F.col("_i").alias("to"), F.col("_j").alias("by"), "n"),
        F.struct(F.col("_j").alias("to"), F.col("_i").alias("by"), "n"))).alias("e"))
    edges = both.select(
        F.col("e.to.block").alias("block"), F.col("e.by.block").alias("other"),
        F.col("e.to.at").alias("at"), F.col("e.by.at").alias("by"), F.col("e.n").alias("n"))
    order = ["block", "other", "at", "by"]
    tasks = max(1, math.ceil(2 * pairs / PAIRS_PER_TASK))
    spread = edges.repartition(1) if tasks == 1 else edges.repartitionByRange(tasks, *order)

    def pack(batches):
        held, size, cell = [], 0, None

        def row():
            at, with_, count = (np.concatenate(part) for part in zip(*held, strict=True))
            return pa.RecordBatch.from_pydict({
                "block": [cell[0]], "other": [cell[1]], "at": [at.tobytes()],
                "by": [with_.tobytes()], "n": [count.tobytes()]}, CELL)

        for batch in batches:
            if not len(batch):
                continue
            block, other, at, with_, count = (batch[c].to_numpy(zero_copy_only=False) for c in (*order, "n"))
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(other) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(block)], strict=True):
                this = (int(block[low]), int(other[low]))
                if held and (this != cell or size >= PAIRS_PER_ROW):
                    yield row()
                    held, size = [], 0
                cell, size = this, size + int(high - low)
                held.append((at[low:high], with_[low:high], count[low:high]))
        if held:
            yield row()

    return cut(spread.sortWithinPartitions(*order).mapInArrow(pack, CELL_FIELDS))


def _loads(batches):
    """Partial denominators of a block, as far as the rows of a task go."""
    block, load = None, None
    for batch in batches:
        for row in batch.to_pylist():
            s, other = np.frombuffer(row["s"]), np.frombuffer(row["s_other"])
            if block != row["block"]:
                if block is not None:
                    yield pa.RecordBatch.from_pydict({"block": [block], "load": [load.tobytes()]}, LOAD)
                block, load = row["block"], np.zeros(len(s))
            at, with_ = np.frombuffer(row["at"], np.int32), np.frombuffer(row["by"], np.int32)
            load += np.bincount(at, np.frombuffer(row["n"]) / (s[at] + other[with_]), len(s))
    if block is not None:
        yield pa.RecordBatch.from_pydict({"block": [block], "load": [load.tobytes()]}, LOAD)


def _stepped(wins, s, load, prior: float):
    """The minorize-maximize step of items with the denominators ``load``."""
    return np.maximum((wins + prior) / (2.0 * prior / (s + 1.0) + load), FLOOR)


def sweep(cells: DataFrame, blocks: DataFrame, prior: float, broadcast: bool) -> DataFrame:
    """One minorize-maximize step: adds ``u``, the new strengths before normalizing, to ``blocks``.

    ``blocks`` holds ``(block, wins, s, before)``, packed arrays over the items of a block. Each
    block is sent to its row and its column of cells, by broadcast or else by a join on the block;
    partial denominators, one per task and block, come back. The other columns are sums and
    extremes over the block, for the scale and the change.
    """
    side = blocks.select("block", "s")
    turned = side.select(F.col("block").alias("other"), F.col("s").alias("s_other"))
    sent = [F.broadcast(t) if broadcast else t for t in (side, turned)]
    # a broadcast leaves the cells in their order
    loads = cells.join(sent[0], "block").join(sent[1], "other").select(
        "block", "at", "by", "n", "s", "s_other").mapInArrow(_loads, "block int, load binary")

    def step(state: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        wins, s = (np.frombuffer(state[c].iloc[0]) for c in ("wins", "s"))
        load = np.sum([np.frombuffer(x) for x in parts["load"]], axis=0)
        u = _stepped(wins, s, load, prior)
        r2 = w = w2 = 0.0
        if state["before"].iloc[0] is not None:
            move = np.log(s) - np.log(np.frombuffer(state["before"].iloc[0]))
            bend = np.log(u) - np.log(s) - move
            r2, w, w2 = (move * move).sum(), bend.sum(), (bend * bend).sum()
        return state.assign(
            u=u.tobytes(), items=len(u), log_sum=np.log(u).sum(), high=(u / s).max(), low=(u / s).min(),
            least=u.min(), r2=r2, w=w, w2=w2)

    return blocks.groupBy("block").cogroup(loads.groupBy("block")).applyInPandas(
        step, f"{BLOCK}, u binary, items bigint, log_sum double, high double, low double, least double, "
              "r2 double, w double, w2 double")


def _extrapolated(before, s, u, scale: float, r2: float, w: float, w2: float):
    """Strengths beyond two plain sweeps, from ``before`` over ``s`` to ``u / scale``.

    In logarithms the two steps r and r + v give the point ``before - 2 a r + a^2 v`` with
    ``a = -|r| / |v|`` (squared extrapolation). It keeps the geometric mean at 1. ``r2``, ``w`` and
    ``w2`` are means over all items, of r^2 and of v and v^2 before the shift by the scale.
    """
    shift = math.log(scale)
    v2 = w2 - 2 * shift * w + shift * shift
    a = -max(1.0, math.sqrt(r2 / v2)) if v2 > 0 else -1.0
    r = np.log(s) - np.log(before)
    v = np.log(u) - shift - 2.0 * np.log(s) + np.log(before)
    return np.maximum(np.exp(np.log(before) - 2.0 * a * r + a * a * v), FLOOR)


def _advanced(swept: DataFrame, scale: float, jump: bool, seen: dict) -> DataFrame:
    """The blocks that the next sweep starts from."""
    r2, w, w2 = (seen[k] / seen["items"] for k in ("r2", "w", "w2"))

    def move(frames):
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                s, u = np.frombuffer(row.s), np.frombuffer(row.u)
                if jump:
                    new = _extrapolated(np.frombuffer(row.before), s, u, scale, r2, w, w2)
                else:
                    new = np.maximum(u / scale, FLOOR)
                rows.append((row.block, row.wins, new.tobytes(), None if jump else row.s))
            yield pd.DataFrame(rows, columns=["block", "wins", "s", "before"])

    return swept.select("block", "wins", "s", "before", "u").mapInPandas(move, BLOCK)


def _settled_block(
    cells: DataFrame, blocks: DataFrame, prior: float, sweeps: int, tol: float
) -> tuple[DataFrame, int]:
    """At most so many sweeps with extrapolation inside the only block, and how many there were.

    Its pairs are one row of ``cells``. Only for a counted number of pairs within ``PAIRS_PER_ROW``, where a job per sweep would cost more
    than the sweep. The sweeps after it, which are jobs, decide about the end.
    """
    def settle(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                wins, s, n = (np.frombuffer(x) for x in (row.wins, row.s, row.n))
                at, with_ = np.frombuffer(row.at, np.int32), np.frombuffer(row.by, np.int32)
                before, used = None, 0
                while used < sweeps:
                    used += 1
                    u = _stepped(wins, s, np.bincount(at, n / (s[at] + s[with_]), len(s)), prior)
                    scale = math.exp(np.log(u).mean())
                    new = np.maximum(u / scale, FLOOR)
                    if np.abs(new / s - 1.0).max() < tol:
                        s = new
                        break
                    if before is None:
                        before, s = s, new
                        continue
                    move = np.log(s) - np.log(before)
                    bend = np.log(u) - np.log(s) - move
                    s = _extrapolated(before, s, u, scale, (move * move).mean(), bend.mean(), (bend * bend).mean())
                    before = None
                yield pd.DataFrame({"block": [row.block], "wins": [row.wins], "s": [s.tobytes()], "before": [None],
                                    "used": [used]})

    found = cut(blocks.join(F.broadcast(cells.drop("other")), "block").select(
        "block", "wins", "s", "n", "at", "by").mapInPandas(settle, f"{BLOCK}, used int"))
    return found.drop("used"), found.first()["used"]


def _blocks(items: DataFrame) -> DataFrame:
    """Item rows as one row of packed arrays per block."""
    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        return pd.DataFrame({"block": [key[0]], "wins": [rows["wins"].to_numpy(float).tobytes()],
                             "s": [rows["s"].to_numpy(float).tobytes()], "before": [None]})

    return cut(items.select("block", "at", "wins", "s").groupBy("block").applyInPandas(pack, BLOCK))


def _strengths(items: DataFrame, swept: DataFrame, scale: float) -> DataFrame:
    """``(item, strength)`` from the packed strengths."""
    def unpack(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        u = np.frombuffer(state["u"].iloc[0])
        return pd.DataFrame({"item": rows["item"], "strength": np.maximum(u[rows["at"]] / scale, FLOOR)})

    return items.select("item", "block", "at").groupBy("block").cogroup(
        swept.select("block", "u").groupBy("block")).applyInPandas(unpack, "item string, strength double")


def bradley_terry(
    pairs: DataFrame,
    iterations: int = 500,
    tol: float = 1e-8,
    prior: float = 0.5,
    start: DataFrame | None = None,
    accelerate: bool = True,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
    block_rows: int = STRENGTHS_PER_BLOCK,
) -> DataFrame:
    """Strengths ``(item, strength)`` with geometric mean 1, from outcomes ``(a, b, winner)``.

    Every item gets ``prior`` wins and losses against an opponent of strength 1. Sweeps stop once
    the largest relative change of one falls below ``tol``, or after ``iterations``. The fixed
    point does not depend on where sweeps begin, so two things save sweeps: ``start (item,
    strength)`` begins from stored strengths, and ``accelerate`` extrapolates after every second
    sweep. Turn it off to get the strengths after an exact number of sweeps. Error rows of the
    tally are left out.

    The pair table is aggregated once and laid out once as cells: items are dealt to blocks, and a
    cell holds the pairs between two blocks as packed arrays. A sweep is one job that sends each
    block's strengths to its row and column of cells; the pairs stay where they lie. Packed, a
    strength takes eight bytes, so sixteen times ``broadcast_rows`` of them are broadcast, and more
    are joined by block. The scale and the change are observed while the blocks are written.
    """
    prior = max(0.0, prior)
    by_pair = cut(outcomes_by_pair(split_outcomes(pairs)[0]))
    items = item_totals(by_pair).filter("item is not null").select(
        "item", "wins", slots_of(F.col("degree"), hot_rows).alias("slots"), F.lit(1.0).alias("s")
    )
    if start is not None:
        begin = start.select("item", F.greatest("strength", F.lit(FLOOR)).alias("_s"))
        items = items.join(begin, "item", "left").withColumn("s", F.coalesce("_s", "s")).drop("_s")
    items = cut(items)
    n = items.count()
    if n == 0:
        return items.select("item", F.col("s").alias("strength"))
    if start is not None:
        first = math.exp(items.agg(F.avg(F.ln("s"))).first()[0])
        items = items.withColumn("s", F.col("s") / first)
    # in the order of a hash, blocks are alike and an item's place does not tell about its pairs
    number = with_position(items, F.xxhash64("item"), F.col("item"))
    items = cut(number.withColumn("block", F.floor(F.col("position") / block_rows).cast("int")).withColumn(
        "at", (F.col("position") % block_rows).cast("int")).drop("position"))
    met = by_pair.count()
    cells = _grid(by_pair, items, met, n, broadcast_rows)
    blocks = _blocks(items)
    left = max(1, iterations)
    if accelerate and left > 1 and n <= block_rows and 2 * met <= PAIRS_PER_ROW:
        blocks, used = _settled_block(cells, blocks, prior, left - 1, tol)
        left -= used
    second = False
    for _ in range(left):
        watch = Observation()
        swept = cut(sweep(cells, blocks, prior, n <= 16 * broadcast_rows).observe(
            watch, F.max("high").alias("high"), F.min("low").alias("low"), F.min("least").alias("least"),
            *[F.sum(c).alias(c) for c in ("items", "log_sum", "r2", "w", "w2")],
        ))
        seen = watch.get
        scale = math.exp(seen["log_sum"] / seen["items"])
        if seen["least"] / scale <= FLOOR * (1 + 1e-9):  # the floor holds some strengths in place
            delta = _largest_change(swept, scale)
        else:
            delta = max(abs(seen["high"] / scale - 1.0), abs(seen["low"] / scale - 1.0))
        if delta < tol:
            break
        jump = accelerate and second
        blocks = _advanced(swept, scale, jump, seen)
        second = accelerate and not second
    return _strengths(items, swept, scale)


def _largest_change(swept: DataFrame, scale: float) -> float:
    """The largest relative change of a strength, floored ones included."""
    def change(frames):
        for frame in frames:
            for u, s in zip(frame["u"], frame["s"], strict=True):
                s = np.frombuffer(s)
                yield pd.DataFrame({"d": [(np.abs(np.maximum(np.frombuffer(u) / scale, FLOOR) - s) / s).max()]})

    return swept.select("u", "s").mapInPandas(change, "d double").agg(F.max("d")).first()[0]


def _near(a, b):
    """Whether two strength columns count as equal."""
    return F.abs(a - b) <= F.greatest(
        F.lit(REL_TOL) * F.greatest(F.abs(a), F.abs(b)), F.lit(ABS_TOL)
    )


def _lead_block(block: pd.DataFrame, carry: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The strength that opened each row's rank, continuing the rank handed in."""
    block = block.sort_values("position")
    values = block["strength"].to_numpy(float)
    leads = np.empty_like(values)
    lead = float(carry["lead"].iloc[0]) if len(carry) else None
    at = 0
    while at < len(values):
        if lead is None:
            lead = values[at]
        # values fall, so those near the lead form a prefix
        slack = max(REL_TOL * abs(lead), ABS_TOL)
        end = int(np.searchsorted(-values, -(lead - 2 * slack), side="right"))
        near = np.abs(values[at:end] - lead) <= np.maximum(
            REL_TOL * np.maximum(np.abs(values[at:end]), abs(lead)), ABS_TOL
        )
        stop = at + (int(near.argmin()) if not near.all() else len(near)) if len(near) else at
        leads[at:stop] = lead
        if stop < len(values):
            lead = None
        at = stop
    return (
        pd.DataFrame({"item": block["item"], "strength": values, "lead": leads}),
        pd.DataFrame({"lead": [] if lead is None else [lead]}),
    )


def rank_scores(strengths: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(item, strength, rank)`` with dense ranks from the strongest, ties by id.

    Strengths near the first one of a rank share the rank. Breaks between neighbours give the
    same ranks unless near-equal values drift away from the first one; only when that is found,
    a sequential scan in blocks decides.
    """
    rows = strengths.select("item", "strength")
    order = [F.col("strength").desc(), F.col("item")]
    ranked = cut(segments(rows, order, lambda p, t: _near(p["strength"], t["strength"]),
                          F.col("strength")))
    if not ranked.filter(~_near(F.col("head"), F.col("strength"))).isEmpty():
        blocks = with_position(rows, *order).withColumn(
            "block", F.floor(F.col("position") / block_rows).cast("bigint")
        )
        leads = carried_scan(
            blocks, _lead_block, "item string, strength double, lead double", "lead double"
        ).drop("block")
        ranked = segments(leads, order, lambda p, t: p["lead"] == t["lead"], F.col("lead"))
    return ranked.select("item", "strength", (F.col("segment") + 1).alias("rank"))


def merge_scores(scores: DataFrame, ranked: DataFrame, now=None) -> DataFrame:
    """Upsert strengths and ranks into the score table; stars stay."""
    stamp = F.current_timestamp() if now is None else now
    updates = ranked.select(
        F.col("item").alias("asset_id"), F.col("strength").alias("bt_score"), "rank",
        stamp.alias("updated_at"),
    )
    return merge_upsert(scores, updates, "asset_id")
