from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pickline.llm import jaccard
from pickline.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, rid long, n string, component_id int"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def set_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [set_of(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed, n):
    """Texts with copies, edits of all sizes, shared lines and long ones."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    shared = [" ".join(rng.choices(vocab, k=rng.choice([8, 30, 60]))) for _ in range(4)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.45 and texts:
            w = words_of(rng.choice(texts))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.3:
                w += rng.choices(vocab, k=rng.choice([1, 5, 20]))
            texts.append(" ".join(w))
        else:
            t = " ".join(rng.choices(vocab, k=rng.choice([0, 1, 3, 4, 5, 6, 20, 60, 150, 900])))
            if rng.random() < 0.5:
                t += "\n" + rng.choice(shared)
            texts.append(t)
    return [(i * 3, t) for i, t in enumerate(texts)]


def found(spark, rows, **settings):
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA).repartition(4)
    got = jaccard.similar_groups(df, **settings).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_as_brute_force(spark, seed):
    rows = corpus(seed, 220)
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (None, rows[7][1]), (None, "no one else has this text at all"),
             (5003, "UPPER case Words that Repeat here"), (5004, "upper CASE words that repeat here"), (rows[9][0], rows[9][1])]
    assert found(spark, rows) == brute(rows)


def test_heavy_cells_and_long_lists(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL_LIST", 3)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):  # a third of all rows is one near-copy group
        w = list(base)
        for _ in range(rng.choice([1, 2, 4, 8])):
            w[rng.randrange(120)] = f"x{rng.randrange(900)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base[:40] + [f"y{i}_{k}" for k in range(rng.choice([5, 10, 60]))])) for i in range(100)]
    rows += corpus(9, 60)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert found(spark, rows, cell_shingles=2500) == brute(rows)


def chains(seed, sizes, n):
    """Texts of ``n`` word sequences cut at several lengths, each set within the next larger one."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        w = [f"c{seed}_{k}_{rng.randrange(10**6)}" for _ in range(max(sizes) + 4)]
        rows += [" ".join(w[: s + 4]) for s in sizes]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("sizes", [(97, 100, 130), (98, 100, 130), (75, 97, 100, 129, 133), (60, 79, 81, 107, 142)])
def test_chains_of_sets_within_sets(spark, sizes):
    rows = chains(len(sizes) + sizes[0], sizes, 60)  # other words are other hashes, so any set is a centre
    assert found(spark, rows) == brute(rows)


def test_blocks_of_a_lower_threshold(spark):
    rows = chains(3, (60, 100, 101, 160), 25)
    want = [(d, n, c) for d, n, c in found(spark, rows, percent=60)]
    assert found(spark, rows, percent=60, cell_shingles=100) == want
    assert len({c for _, _, c in want}) == 25


def test_empty_table(spark):
    assert found(spark, []) == []


@given(st.integers(0, 10**6), st.integers(2, 60))
@settings(max_examples=60, deadline=None)
def test_tree_as_brute_force(seed, n):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(n):
        if sets and rng.random() < 0.6:
            old = sets[rng.integers(len(sets))]
            new = np.concatenate([old[rng.random(len(old)) < rng.choice([0.8, 0.9, 1])], rng.integers(0, 10**9, rng.integers(0, 6))])
            new = np.unique(new.astype(np.uint64))
        else:
            new = np.unique(rng.integers(0, 10**9, rng.integers(1, 80)).astype(np.uint64))
        sets.append(new if len(new) else np.array([1], np.uint64))
    for side in (np.zeros(n, int), rng.integers(0, 2, n)):
        two = len(set(side.tolist())) > 1
        want = np.arange(n)
        for i in range(n):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if (not two or side[i] != side[j]) and 175 * both >= 75 * (len(sets[i]) + len(sets[j])):
                    a, b = sorted((want[i], want[j]))
                    want[want == b] = a
        assert jaccard.tree_components(sets, side).tolist() == want.tolist()


def test_shingles_are_sets_of_words():
    texts = ["a b c d e f", "A  b\tc\nd e f", "a b", "", "a b c d e a b c d e a b c d e"]
    hashes, ends = shingle_sets(pa.array(texts))
    assert np.diff(ends, prepend=0).tolist() == [len(set_of(t)) for t in texts]
    assert hashes[:2].tolist() == hashes[2:4].tolist()


def test_one_of_each_group_with_repeats_and_null_ids(spark):
    rows = [(i, t) for i, (_, t) in enumerate(corpus(21, 80))]
    rows += [rows[3], rows[3], rows[11], (None, rows[5][1]), (None, "a text that nobody else has here"),
             (None, "a text that nobody else has here"), (900, None), (900, None), (901, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA).repartition(4)
    kept = jaccard.one_of_each_group(docs)
    assert kept.columns == docs.columns
    component = {}
    for d, n, c in found(spark, rows):
        if d is not None:
            component[d] = c
    want = {(d, t or "") for d, t in rows if d is not None and component[d] == d}
    want |= {(None, "a text that nobody else has here"), (None, "")}
    assert sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_texts_that_nothing_is_like_are_not_shuffled(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(str(rng.random()) for _ in range(2000))) for i in range(150)]
    rows.append((150, rows[0][1] + " more"))
    spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA).write.parquet(str(tmp_path / "docs"))
    before = shuffled_bytes(spark)
    kept = jaccard.one_of_each_group(spark.read.parquet(str(tmp_path / "docs")))
    assert kept.count() == 150
    texts = sum(len(t) for _, t in rows)
    assert shuffled_bytes(spark) - before < texts / 2


def shuffled_bytes(spark):
    """Bytes that all stages so far have written to shuffles; entries of one shingle aside, texts are most."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    store = context.statusStore()
    return sum(e.totalShuffleWrite() for e in (lambda x: [x.apply(i) for i in range(x.size())])(store.executorList(False)))


def test_passages_shared_by_chance_make_few_pairs(spark, monkeypatch):
    rng = random.Random(8)
    passages = [" ".join(f"p{k}_{i}" for i in range(5)) for k in range(40)]  # one shingle each
    rows = []
    for i in range(160):
        w = [f"u{i}_{k}" for k in range(120)]
        for p in rng.sample(passages, 12):
            w[rng.randrange(1, 120) : 0] = [p]
        rows.append((i, " ".join(w)))
    rows += [(500 + i, t + " end") for i, t in rows[:10]] + [(600 + i, " ".join(passages[:20])) for i in range(3)]
    made = []
    pairs = jaccard._cell_pairs
    monkeypatch.setattr(jaccard, "_cell_pairs", lambda *args: made.append(pairs(*args)) or made[0])
    assert found(spark, rows) == brute(rows)
    assert made[0].count() < 160


@pytest.mark.parametrize("short", [1, 2, 8])
def test_lists_of_any_length_as_brute_force(spark, monkeypatch, short):
    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", 1)
    rng = random.Random(short)
    vocab = [f"v{i}" for i in range(9)]  # few words: most shingles are in many texts
    rows = [(i, " ".join(rng.choices(vocab, k=rng.choice([5, 6, 7, 8, 9, 12, 30])))) for i in range(250)]
    rows += [(1000 + i, t + " " + rng.choice(vocab)) for i, t in rows[:60]]
    assert found(spark, rows) == brute(rows)
