import random

import pytest
from pyspark.sql import functions as F

from pickline.operators import ordering


def test_positions_split_a_hot_key(spark, monkeypatch):
    # the test data are small: keep AQE from merging the small range partitions again
    monkeypatch.setattr(ordering, "cut", lambda df: df)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [("hot" if i % 3 else f"k{i:04d}", i) for i in range(3000)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int").repartition(8)
    spread = ordering.globally_ordered(df, F.col("k"), F.col("i"))
    assert spread.filter("k = 'hot'").select("_part").distinct().count() > 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    monkeypatch.undo()
    got = ordering.with_position(df, F.col("k"), F.col("i")).orderBy("position").collect()
    assert [(r.k, r.i) for r in got] == sorted(rows)
    assert [r.position for r in got] == list(range(3000))


def test_segments_across_partitions(spark):
    rng = random.Random(5)
    values, at = [], 0
    for _ in range(2000):
        at += rng.choice([1, 1, 1, 1, 1, 5])
        values.append(at)
    want, start = [], 0
    for i, v in enumerate(values):
        if i and v - values[i - 1] > 1:
            start = i
        end = i + 1 == len(values) or values[i + 1] - v > 1
        want.append((v, i - start, end, values[start]))
    numbers = {}
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    got = ordering.segments(df, [F.col("v")], lambda p, t: t["v"] - p["v"] <= 1, F.col("v"))
    rows = got.orderBy("v").collect()
    assert [(r.v, r.pos, r.last, r.head) for r in rows] == want
    for r in rows:
        numbers.setdefault(r.segment, set()).add(r.head)
    assert sorted(numbers) == list(range(len(numbers)))
    assert all(len(h) == 1 for h in numbers.values())


def test_one_segment_over_everything(spark):
    df = spark.range(1000).repartition(6)
    got = ordering.segments(df, [F.col("id")], lambda p, t: F.lit(True), F.col("id"))
    assert got.filter("pos <> id or head <> 0 or segment <> 0").isEmpty()
    assert [r.id for r in got.filter("last").collect()] == [999]


def mixed(spark, count):
    """Ties, nulls and NaN in the first key, a unique second one."""
    rng = random.Random(count)
    values = [None, float("nan"), float("-inf"), -0.0, 0.0] + [float(v) for v in range(12)]
    return spark.createDataFrame([(rng.choice(values), f"k{i:05d}") for i in range(count)], "v double, k string").repartition(5)


@pytest.mark.parametrize(("rate", "partitions", "batch"), [(0.02, 9, 3), (0.5, 4, 1), (0.9, 1, 100), (0.0, 6, 7)])
def test_segments_as_a_loop(spark, monkeypatch, rate, partitions, batch):
    rng = random.Random(partitions)
    values, at = [], 0
    for _ in range(400):
        at += 5 if rng.random() < rate else 1
        values.append((at, None if rng.random() < 0.3 else f"h{at}"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(values, "v int, h string").repartition(3)
        got = ordering.segments(df, [F.col("v")], lambda p, t: t["v"] - p["v"] <= 1, F.col("h")).orderBy("v").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, segment, start = [], -1, 0
    for i, (v, h) in enumerate(values):
        if i == 0 or v - values[i - 1][0] > 1:
            segment, start = segment + 1, i
        last = i + 1 == len(values) or values[i + 1][0] - v > 1
        want.append((v, h, segment, i - start, last, values[start][1]))
    assert [tuple(r) for r in got] == want


def test_segments_shuffle_rows_once(spark, monkeypatch):
    plans = []
    real = ordering.cut
    monkeypatch.setattr(ordering, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    df = spark.range(1000).repartition(3).withColumn("v", F.col("id") * 2)
    got = ordering.segments(df, [F.col("v")], lambda p, t: t["v"] - p["v"] <= 2, F.col("id"))
    assert plans[0].count("Exchange rangepartitioning") == 1 and plans[0].count("Exchange hashpartitioning") == 0
    final = got._jdf.queryExecution().executedPlan().toString()
    # what is exchanged after it are summaries, one row per partition
    assert "hashpartitioning(_part" in final and final.count("hashpartitioning") <= 1 and "SortMergeJoin" not in final
    assert ordering.segments(df.limit(0), [F.col("v")], lambda p, t: F.lit(True), F.col("id")).collect() == []


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("n", [0, 1, 30, 1500, 2999, 3000, 5000])
def test_top_n_comes_in_order(spark, n, ascending):
    df = mixed(spark, 3000)
    order = [F.col("v").asc() if ascending else F.col("v").desc(), F.col("k").desc() if ascending else F.col("k").asc()]
    want = [r.k for r in df.orderBy(*order).collect()][:n]
    got = ordering.top_n(df, n, ("v", ascending), ("k", not ascending), task_rows=40).collect()
    assert [r.k for r in got] == want


def test_top_n_of_equal_keys(spark):
    same = spark.createDataFrame([(1.0, i) for i in range(500)], "v double, i int")
    assert ordering.top_n(same, 70, ("v", True), task_rows=10).count() == 70
    assert ordering.top_n(same.limit(0), 5, ("v", True)).collect() == []


@pytest.mark.parametrize(("n", "task_rows"), [(500, 1000), (50_000, 1000)])
def test_top_n_never_shuffles_the_table(spark, monkeypatch, n, task_rows):
    written, sorted_rows = [], []
    real = ordering.cut
    monkeypatch.setattr(ordering, "cut", lambda df: written.append(
        df._jdf.queryExecution().executedPlan().toString()) or real(df))
    place = ordering.with_position
    monkeypatch.setattr(ordering, "with_position", lambda df, *a, **k: sorted_rows.append(df.count()) or place(df, *a, **k))
    df = spark.range(200_000).withColumn("v", F.xxhash64("id"))
    got = ordering.top_n(df, n, ("v", False), ("id", True), task_rows=task_rows)
    assert "Exchange" not in written[0]  # the whole table is written where it lies
    assert got.count() == n
    if n > task_rows:
        assert n <= sorted_rows[0] <= n + task_rows
    else:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
        assert plan.count("Filter") >= 1


def test_a_long_top_n_comes_in_order(spark):
    got = [r.id for r in ordering.top_n(spark.range(150_000), 120_000, ("id", False)).collect()]
    assert got == list(range(149_999, 29_999, -1))
