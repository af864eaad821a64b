from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import functions as F

from pickline.llm import chat

SF = "/root/testdata/sf0.01"


def test_best_path_as_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        model = chat.model_of({(k, a, b): int(rng.integers(0, 50)) for k in ("start", "step", "0", "1", "2", "3")
                               for a in range(6) for b in range({"start": 1, "step": 6, "0": 4, "1": 2, "2": 4, "3": 2}[k])})
        lines = np.stack([rng.integers(0, n, 5) for n in chat.SHOWN], 1)
        own = model.scores(lines)

        def score(path, own=own, model=model):
            return model.start[path[0]] + own[range(5), path].sum() + sum(model.step[a, b] for a, b in itertools.pairwise(path))

        best = max(score(list(p)) for p in itertools.product(range(6), repeat=5))
        states, up, _ = chat.decode(model, lines)
        assert score(states.tolist()) == best
        _, up, _ = chat.decode(model, lines[:2])
        _, _, down = chat.decode(model, lines[2:], before=up)
        left, _, _ = chat.decode(model, lines[:2], after=down)
        right, _, _ = chat.decode(model, lines[2:], before=up)
        assert score([*left.tolist(), *right.tolist()]) == best


def test_held_out_roles_and_blocks(spark):
    raw = chat.as_transcripts(spark.read.parquet(f"{SF}/conversations.parquet")).cache()
    half = F.pmod(F.xxhash64("conv_id", F.lit(1)), F.lit(2))
    model = chat.train(raw.filter(half == 0))
    held = raw.filter(half == 1)
    got = chat.parse_transcripts(held.drop("role"), model)
    first = got.filter("piece = 0").select("conv_id", "turn", F.col("role").alias("found"))
    both = held.join(first, ["conv_id", "turn"]).toPandas()
    assert len(both) == held.count() and (both.role == both.found).mean() > 0.9
    small = chat.parse_transcripts(held.drop("role"), model, block_turns=2)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(small) == key(got)


def test_odd_rows(spark):
    model = chat.train(chat.as_transcripts(spark.read.parquet(f"{SF}/conversations.parquet")))
    rows = [(1, 0, "User: hi?\nAssistant: hello\nUser: bye"), (1, 1, None), (None, 3, "User: alone"), (2, None, ""),
            (2, None, ""), (3, 0, "Q: " + "x " * 50_000), (4, 5, "Assistant: a"), (4, 900, "User: b")]
    df = spark.createDataFrame([(*r, "p", "o") for r in rows], "conv_id long, turn long, text string, piece string, opens string")
    got = chat.parse_transcripts(df, model).collect()
    pieces = [(r.role, r.rendered) for r in sorted((r for r in got if r.conv_id == 1 and r.turn == 0), key=lambda r: r.piece)]
    assert pieces == [("user", "<|user|>\nhi?"), ("assistant", "<|assistant|>\nhello"), ("user", "<|user|>\nbye")]
    assert {r.role for r in got if r.conv_id is None} == {"user"}
    assert chat.parse_transcripts(df.limit(0), model).collect() == []
