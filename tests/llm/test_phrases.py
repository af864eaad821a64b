from __future__ import annotations

import hashlib
import random
import re

import pytest

from pickline.llm import phrases

SCHEMA = "doc_id long, text string, segment string, items int, n_words string"


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items):
    out = []
    for d, text in rows:
        w, hit, ids = words(text), set(), set()
        for i, t in items:
            own = words(t)
            if i is None or not own:
                continue
            n = min(13, len(own))
            for k in range(len(own) - n + 1):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == own[k : k + n]:
                        hit |= set(range(p, p + n))
                        ids.add(str(i))
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(ids), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def case():
    rng = random.Random(3)
    vocab = "the of and zu über ñandú x1 42 a b".split()
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 4, 13, 20, 40])))) for i in range(12)]
    items += [(50, None), (51, "..."), (None, "the of"), (3, items[3][1]), (60, items[4][1].upper() + " ZU")]
    rows = []
    for d in range(60):
        text = " ".join(rng.choices(vocab, k=rng.choice([0, 1, 30, 300])))
        if rng.random() < 0.6:
            text += rng.choice([". ", "\n", "-"]) + (rng.choice(items)[1] or "") + " " + rng.choice(vocab)
        rows.append((d, text))
    rows += [(100, None), (101, ""), (None, items[2][1]), (7, rows[7][1]), (102, "zz " * 40_000 + items[5][1])]
    return rows, items


@pytest.mark.parametrize("block_words", [500_000, 60])
def test_as_brute_force(spark, block_words):
    rows, items = case()
    docs = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA).repartition(3)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    got = phrases.contamination(docs, bench, block_words=block_words).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "", 1, "")], SCHEMA)
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in phrases.contamination(docs, none).collect()] == [0]
    assert phrases.contamination(docs.limit(0), none).collect() == []


def test_near(spark):
    rows = [(1, "a x b y c"), (2, "a b c"), (3, "a x x x x x b c"), (4, "c b a a"), (5, "a b"), (6, "c d")]
    index = phrases.build_index(spark.createDataFrame(rows, "doc_id long, text string"))
    got = phrases.find_near(index, [(1, "a b c"), (2, "missing a"), (3, "")], 5).collect()
    assert sorted({(r.doc_id, r.query_id) for r in got}) == [(1, 1), (2, 1), (4, 1)]
    assert {(r.doc_id, r.start) for r in phrases.find_near(index, [(1, "a b c")], 3).collect()} == {(2, 0), (4, 0)}


def test_segments_and_row_groups_stay_small(spark):
    import pyarrow.parquet as pq

    text = " ".join(f"w{i}" for i in range(4000))
    docs = spark.createDataFrame([(i, text) for i in range(600)], "doc_id long, text string").coalesce(1)
    index = phrases.build_index(docs)
    most = len(text) + phrases.SEGMENT_BYTES
    assert all(r.b <= most for r in index.selectExpr("size(doc_ids) * %d AS b" % len(text)).collect())
    groups = 0
    for path in index.inputFiles():
        meta = pq.ParquetFile(path.removeprefix("file://")).metadata
        rows = [meta.row_group(g).num_rows for g in range(meta.num_row_groups)]
        assert all(n <= phrases.GROUP_SEGMENTS for n in rows)
        groups += len(rows)
    assert groups >= 2
    assert index.selectExpr("sum(size(doc_ids)) n").first().n == 600
