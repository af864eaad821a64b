"""Roles of transcript lines by a hidden Markov model, and canonical turns from them.

States are a role and whether a line begins a turn. A line shows its speaker marker, whether it
begins a row, its length and its last mark; given the state these are independent. Probabilities are
counts over labelled rows. Viterbi scores are whole numbers, so that a conversation may be cut in
blocks of ``BLOCK_TURNS`` turns: the best scores on either side of a cut are handed on until they no
longer change, and every line then has the state of the best path, as if it had been read whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickline.llm.common import table
from pickline.session import cut

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # role r begins a turn: 2 r; goes on: 2 r + 1
BLOCK_TURNS = 256
SCALE = 1 << 20

# How speakers are marked.
_MARKERS = (
    ("system", "system instruction instructions context"),
    ("user", "user human q question customer me prompter"),
    ("assistant", "assistant ai bot a answer model agent response"),
)
_SPEAKER = {w: i for i, (_, words) in enumerate(_MARKERS) for w in words.split()}
_MARK = re.compile(r"^\s{0,8}(?:<\|(\w{1,20})\|>|\[(\w{1,20})\]|#{1,4}\s?(\w{1,20})\s?:?|\**(\w{1,20})\**\s?[:>])\s?")
#: Values of each thing a line shows.
SHOWN = (4, 2, 4, 2)


def speaker(line: str) -> tuple[int, int]:
    """The role a marker names, and where the line goes on; no marker: one past the last role, 0."""
    m = _MARK.match(line)
    role = _SPEAKER.get(next(filter(None, m.groups())).lower()) if m else None
    return (len(ROLES), 0) if role is None else (role, m.end())


def shown(line: str, first: bool) -> tuple[int, int, int, int]:
    """What a line shows: marker, beginning of a row, length class, question."""
    n = len(line.split())
    return speaker(line)[0], int(first), (n > 0) + (n > 8) + (n > 40), int(line.rstrip().endswith("?"))


@dataclass
class Model:
    """Scaled logarithms: of beginnings, of steps, and of what each state shows."""

    start: np.ndarray
    step: np.ndarray
    show: list[np.ndarray]

    def scores(self, lines: np.ndarray) -> np.ndarray:
        return sum(show[:, lines[:, k]].T for k, show in enumerate(self.show))


def model_of(counts: dict[tuple[str, int, int], int]) -> Model:
    """Smoothed probabilities of ``(kind, state, value) -> count``."""
    def logs(rows):
        rows = rows + 0.5
        return np.round(np.log(rows / rows.sum(-1, keepdims=True)) * SCALE).astype(np.int64)

    start, step = np.zeros(STATES), np.zeros((STATES, STATES))
    show = [np.zeros((STATES, n)) for n in SHOWN]
    for (kind, a, b), n in counts.items():
        if kind == "start":
            start[a] += n
        elif kind == "step":
            step[a, b] += n
        else:
            show[int(kind)][a, b] += n
    # labelled rows begin where turns do; a tenth is kept for turns that begin within a row
    show[1][::2, 0] += show[1][::2].sum(1) / 10
    start[1::2] = -0.49
    return Model(logs(start), logs(step), [logs(s) for s in show])


def decode(model: Model, lines: np.ndarray, before=None, after=None):
    """States of the best path, best scores up to the last line, and from the first line on.

    ``before`` are the best scores up to the line before, ``after`` from the line after on; None at
    the ends of the conversation. Scores handed on are relative to their best.
    """
    own, n = model.scores(lines), len(lines)
    up, down = np.zeros((n, STATES), np.int64), np.zeros((n, STATES), np.int64)
    up[0] = own[0] + (model.start if before is None else (before[:, None] + model.step).max(0))
    for t in range(1, n):
        up[t] = own[t] + (up[t - 1][:, None] + model.step).max(0)
    down[-1] = 0 if after is None else (model.step + after).max(1)
    for t in range(n - 2, -1, -1):
        down[t] = (model.step + own[t + 1] + down[t + 1]).max(1)
    first = own[0] + down[0]
    states = np.zeros(n, np.int64)
    states[0] = (up[0] + down[0]).argmax()
    for t in range(1, n):  # along the path, so that ties can't break it
        states[t] = (model.step[states[t - 1]] + own[t] + down[t]).argmax()
    return states, up[-1] - up[-1].max(), first - first.max()


def _observed(texts) -> tuple[np.ndarray, list[tuple[int, str]]]:
    lines = [(k, line) for k, t in enumerate(texts) for line in (t or "").split("\n")]
    seen, out = set(), []
    for k, line in lines:
        out.append(shown(line, k not in seen))
        seen.add(k)
    return np.array(out, np.int64), lines


def train(rows: DataFrame) -> Model:
    """The model of labelled rows ``(conv_id, turn, role, text)``, each of which is one turn.

    Only rows with a known role and a turn number teach; their number isn't bounded, the counts are.
    """
    known = rows.filter(F.col("role").isin(*ROLES) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    before = known.select(F.col("conv_id").alias("b_id"), (F.col("turn") + 1).alias("b_turn"),
                          F.col("role").alias("b_role"), F.size(F.split("text", "\n")).alias("b_lines")) \
        .dropDuplicates(["b_id", "b_turn"])
    pairs = known.join(before, (F.col("conv_id") == F.col("b_id")) & (F.col("turn") == F.col("b_turn")), "left")

    def count(batches):
        for b in batches:
            sums: dict[tuple, int] = {}
            for role, text, b_role, b_lines in zip(b.role, b.text, b.b_role, b.b_lines, strict=True):
                r = ROLES.index(role)
                found, _ = _observed([text])
                if b_role is None:
                    keys = [("start", 2 * r, 0)]
                else:
                    keys = [("step", 2 * ROLES.index(b_role) + int(b_lines > 1), 2 * r)]
                for t, line in enumerate(found):
                    state = 2 * r + (t > 0)
                    keys += [(str(k), state, int(v)) for k, v in enumerate(line)]
                    if t:
                        keys.append(("step", 2 * r + (t > 1), state))
                for key in keys:
                    sums[key] = sums.get(key, 0) + 1
            yield pd.DataFrame([(*k, n) for k, n in sums.items()], columns=["kind", "a", "b", "n"])

    found = pairs.select("role", "text", "b_role", "b_lines").mapInPandas(count, "kind string, a int, b int, n long")
    return model_of({(r.kind, r.a, r.b): r.n for r in found.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()})


def parse_transcripts(rows: DataFrame, model: Model, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Canonical pieces ``(conv_id, turn, piece, role, opens, rendered)`` of ``(conv_id, turn, text)``.

    A piece is a run of lines of one row in one turn: markers are cut off, and the piece that opens a
    turn begins with ``<|role|>``. The pieces of a conversation in order are its canonical text. Rows
    are read by turn, ties by text; null turns come first. A null text is an empty line. Rows with a
    null ``conv_id`` are one-row conversations by text. Repeated rows are lines again. An empty table
    gives no rows. ``turn`` numbers repeated without bound share a block.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    rows = cut(rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("text", F.lit("")).alias("text"),
        F.when(F.col("conv_id").isNull(), F.xxhash64("text")).otherwise(0).alias("lone"),
        F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-1)).cast("long").alias("block")))
    blocks = rows.select("conv_id", "lone", "block").distinct()
    many = blocks.groupBy("conv_id", "lone").agg(F.array_sort(F.collect_list("block")).alias("all")).filter("size(all) > 1")
    order = cut(many.select(
        "conv_id", "lone", F.explode(F.arrays_zip(
            F.col("all").alias("block"),
            F.concat(F.array(F.lit(None).cast("long")), F.slice("all", 1, F.size("all") - 1)).alias("prev"),
            F.concat(F.slice("all", F.lit(2), F.size("all") - 1), F.array(F.lit(None).cast("long"))).alias("next"))).alias("x"),
    ).select("conv_id", "lone", "x.*"))
    key = ["conv_id", "lone", "block"]
    schema = "conv_id long, lone long, block long, before array<long>, after array<long>"
    hints = rows.sparkSession.createDataFrame([], schema)

    def given(name, pdf):
        value = pdf[name].iloc[0]
        return None if value is None else np.array(value, np.int64)

    def edges(pdf):
        pdf = pdf.sort_values(["turn", "text"], na_position="first")
        lines, _ = _observed(pdf.text)
        _, up, down = decode(shared.value, lines, given("before", pdf), given("after", pdf))
        return pd.DataFrame([(*pdf[["conv_id", "lone", "block"]].astype(object).iloc[0], pdf.prev.iloc[0], pdf.next.iloc[0],
                              up.tolist(), down.tolist())], columns=["conv_id", "lone", "block", "prev", "next", "up", "down"])

    def parse(pdf):
        pdf = pdf.sort_values(["turn", "text"], na_position="first")
        found, lines = _observed(pdf.text)
        states, _, _ = decode(shared.value, found, given("before", pdf), given("after", pdf))
        out, turns, conv = [], pdf.turn.tolist(), pdf.conv_id.iloc[0]
        for (k, line), state in zip(lines, states.tolist(), strict=True):
            opens = state % 2 == 0
            line = line[speaker(line)[1]:] if opens else line
            if opens or not out or out[-1][0] != k:
                piece = out[-1][2] + 1 if out and out[-1][0] == k else 0
                out.append([k, turns[k], piece, ROLES[state // 2], opens, (f"<|{ROLES[state // 2]}|>\n" if opens else "") + line])
            else:
                out[-1][5] += "\n" + line
        frame = pd.DataFrame([x[1:] for x in out], columns=["turn", "piece", "role", "opens", "rendered"])
        frame["turn"] = frame["turn"].astype("Int64")
        frame.insert(0, "conv_id", pd.array([None if pd.isna(conv) else int(conv)] * len(frame), "Int64"))
        return frame

    if not order.isEmpty():
        cuts = rows.withColumnRenamed("lone", "l").join(
            order.withColumnsRenamed({"conv_id": "o_id", "block": "o_block"}),
            F.col("conv_id").eqNullSafe(F.col("o_id")) & (F.col("l") == F.col("lone")) & (F.col("block") == F.col("o_block"))
        ).drop("o_id", "o_block", "l")
        while True:
            out = cut(_with(cuts, hints).groupBy(*key).applyInPandas(
                edges, "conv_id long, lone long, block long, prev long, next long, up array<long>, down array<long>"))
            new = out.select("conv_id", "lone", F.col("next").alias("block"), F.col("up").alias("before"),
                             F.lit(None).cast("array<long>").alias("after")).unionByName(
                out.select("conv_id", "lone", F.col("prev").alias("block"), F.lit(None).cast("array<long>").alias("before"),
                           F.col("down").alias("after"))).filter("block is not null")
            new = cut(new.groupBy(*key).agg(F.max("before").alias("before"), F.max("after").alias("after")))
            settled = new.exceptAll(hints).isEmpty()
            hints = new
            if settled:
                break
    return _with(rows, hints).groupBy(*key).applyInPandas(
        parse, "conv_id long, turn long, piece int, role string, opens boolean, rendered string")


def _with(rows: DataFrame, hints: DataFrame) -> DataFrame:
    hints = hints.withColumnsRenamed({"conv_id": "h_id", "lone": "h_lone", "block": "h_block"})
    return rows.join(hints, F.col("conv_id").eqNullSafe(F.col("h_id")) & (F.col("lone") == F.col("h_lone"))
                     & (F.col("block") == F.col("h_block")), "left").drop("h_id", "h_lone", "h_block")


def as_transcripts(rows: DataFrame) -> DataFrame:
    """Labelled turns as raw text: two conversations of three mark speakers, in several styles."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(6))
    name = F.initcap("role")
    marked = (F.when(style == 0, F.concat(name, F.lit(": "), "text"))
              .when(style == 1, F.concat(F.lit("### "), name, F.lit(": "), "text"))
              .when(style == 2, F.concat(F.lit("["), "role", F.lit("] "), "text"))
              .when(style == 3, F.concat(F.when(F.col("role") == "user", "Q").when(F.col("role") == "assistant", "A")
                                         .otherwise("Context"), F.lit(": "), "text")))
    return rows.withColumn("text", F.coalesce(marked, "text"))


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    """Every conversation as a raw transcript, its roles recovered and its turns rendered."""
    raw = as_transcripts(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return parse_transcripts(raw.drop("role"), train(raw))
