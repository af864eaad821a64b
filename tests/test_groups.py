import hashlib
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pickline.operators import groups
from pickline.operators.skew import attach

T0 = datetime(2024, 6, 1, 10, tzinfo=UTC)
SCHEMA = "id string, taken_at timestamp, camera string, dhash bigint"


def frames(spark, rows):
    return spark.createDataFrame(
        [(i, None if s is None else T0 + timedelta(seconds=s), c, h) for i, s, c, h in rows], SCHEMA)


def listed(spark, rows, gap=10.0, distance=26, cap=10):
    got = groups.burst_groups(frames(spark, rows), gap, distance, cap).orderBy("seq").collect()
    out = {}
    for r in got:
        out.setdefault(r.group_id, []).append(r.member)
    return list(out.values())


@pytest.mark.parametrize(("rows", "want"), [
    ([("a", 0, "C", None), ("b", 10, "C", None), ("c", 20.001, "C", None)], [["a", "b"]]),
    ([("a", 0, "C", None), ("b", 1, "O", None), ("c", 2, "C", None)], [["a", "c"]]),
    ([("a", 0, "C", 0), ("b", 1, "C", 0), ("c", 2, "C", 2**27 - 1)], [["a", "b"]]),
    ([("a", 0, "C", 0), ("b", 1, "C", 2**26 - 1)], [["a", "b"]]),
    ([("a", 0, "C", 0), ("b", 1, "C", None), ("c", 2, "C", -1)], [["a", "b", "c"]]),
    ([("a", 0, "", None), ("b", 1, None, None), ("c", None, "", None)], [["a", "b"]]),
])
def test_chains(spark, rows, want):
    assert listed(spark, rows) == want


def test_slices(spark):
    run = [(f"a{i:02d}", i, "C", None) for i in range(25)]
    assert [len(g) for g in listed(spark, run)] == [10, 10, 5]
    assert [len(g) for g in listed(spark, run[:21])] == [10, 10]
    assert listed(spark, run[:5], cap=2) == [["a00", "a01"], ["a02", "a03"]]
    with pytest.raises(ValueError, match="max_group"):
        listed(spark, run, cap=1)


def test_chains_against_a_loop_with_one_hot_camera(spark):
    rng = random.Random(3)
    rows = [(f"i{i:05d}", rng.randrange(0, 20000), "hot" if i % 3 else f"c{i % 7}",
             rng.choice([None, 0, 2**40 - 1])) for i in range(3000)]
    got = listed(spark, rows, cap=4)
    want, chain = [], []

    def flush():
        for s in range(0, len(chain), 4):
            if len(chain[s:s + 4]) > 1:
                want.append([x[2] for x in chain[s:s + 4]])

    prev = None
    for cam, at, ident, h in sorted((c, s, i, h) for i, s, c, h in
                                    [(i, s, c, -1 if h is None else h) for i, s, c, h in rows]):
        alike = prev and (h < 0 or prev[3] < 0 or (h ^ prev[3]).bit_count() <= 26)
        if prev and prev[0] == cam and at - prev[1] <= 10 and alike:
            chain.append((cam, at, ident))
        else:
            flush()
            chain = [(cam, at, ident)]
        prev = (cam, at, ident, h)
    flush()
    assert got == want


def merged(spark, first, second, cap=None, hot=10**6):
    g = spark.createDataFrame(
        [(f"{n:04d}", n * 1000 + i, m) for n, ms in enumerate(first) for i, m in enumerate(ms)],
        "group_id string, seq long, member string")
    d = spark.createDataFrame(
        [(f"{n:04d}", i, m) for n, ms in enumerate(second) for i, m in enumerate(ms)],
        "group_id string, ord int, member string")
    out = {}
    for r in groups.merge_groups(g, d, cap, hot).orderBy("component", "slice", "pos").collect():
        out.setdefault((r.component, r.slice), []).append(r.member)
    return list(out.values())


@pytest.mark.parametrize(("first", "second", "cap", "want"), [
    (["ab", "cd", "ef"], ["bc", "de"], None, [list("abcdef")]),
    (["ba"], ["az", "zc"], None, [list("bazc")]),
    (["mn", "ab"], ["ba"], None, [list("mn"), list("ab")]),
    ([], ["abc"], 2, [list("ab")]),
])
def test_merge(spark, first, second, cap, want):
    assert merged(spark, first, second, cap) == want


def test_merge_against_union_find_with_a_hub(spark):
    rng = random.Random(11)
    names = [f"m{i:04d}" for i in range(400)]
    first = [rng.sample(names, 2) for _ in range(60)]
    second = [rng.sample(names, 3) for _ in range(40)] + [names[:130]]
    parent, order = {}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for g in first + second:
        for m in g:
            order.setdefault(m, len(order))
            parent.setdefault(m, m)
        for m in g[1:]:
            a, b = find(g[0]), find(m)
            if a != b:
                parent[max(a, b, key=order.get)] = min(a, b, key=order.get)
    want = {}
    for m in order:
        want.setdefault(find(m), []).append(m)
    want = [v for v in want.values() if len(v) > 1]
    got = merged(spark, first, second, hot=20)
    assert got == want


def test_long_path_converges(spark):
    ids = list(range(300))
    random.Random(2).shuffle(ids)
    edges = spark.createDataFrame(
        [(max(a, b), min(a, b)) for a, b in zip(ids, ids[1:], strict=False)], "hi long, lo long")
    roots = groups.component_roots(edges)
    assert roots.count() == 300
    assert roots.filter("root <> 0").isEmpty()


def test_keys_and_assignment(spark):
    a = frames(spark, [(x, i, "C", None) for i, x in enumerate("cab")] + [("z", 999, "C", None)])
    a = a.withColumn("burst_id", F.lit("stale"))
    dups = spark.createDataFrame([("d", ["z", "q"])], "duplicateId string, ids array<string>")
    dups = dups.select("duplicateId", F.transform("ids", lambda i: F.struct(i.alias("id")))
                       .alias("assets"))
    out = {r.id: r.burst_id for r in groups.regroup(a, dups).collect()}
    key = "b" + hashlib.sha1(b"a\nb\nc").hexdigest()[:12]
    assert out == {"a": key, "b": key, "c": key, "z": None}
    members = groups.group_members(groups.regroup(a, dups)).collect()
    assert [(r.burst_id, r.member_ids) for r in members] == [(key, ["c", "a", "b"])]


def test_attach_beyond_the_broadcast_limit(spark):
    fact = spark.range(3000).select((F.col("id") % 10 * (F.col("id") % 2)).alias("k"),
                                    F.col("id").alias("v"))
    stats = fact.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    small = attach(fact, stats, "k", "n")
    large = attach(fact, stats, "k", "n", hot_rows=500, broadcast_rows=0)
    assert large.columns == small.columns
    assert large.exceptAll(small).isEmpty() and small.exceptAll(large).isEmpty()
    none = attach(fact, stats.filter("k > 0"), "k", "n", hot_rows=1, broadcast_rows=0)
    assert none.count() == fact.filter("k > 0").count()
