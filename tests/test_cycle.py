"""Nine assets through every stage, against counts worked out by hand."""

from __future__ import annotations

import json
import sys
from datetime import UTC, datetime

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pickline.functions.replies import parse_replies
from pickline.operators import actions, judging, report, skew, worklists
from pickline.operators.judging import FatalJudgeError
from pickline.operators.merges import register_batch
from pickline.plans import cycle, registry
from pickline.schemas import SCORES, Options, align, empty_tables
from pickline.sources.assets import flatten_assets
from pickline.streaming import bursts as stream_ops
from pickline.streaming import watch as watching
from pickline.sources.assets import ASSET_DOCUMENT
from pickline.session import cut
from pickline.sources.tables import save_tables, versions

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NOW = datetime(2024, 7, 1, tzinfo=UTC)
# fixed values of the scenario
QUALITY = {0: 10, 1: 70, 2: 20, 3: 5, 4: 1, 5: 2, 6: 80, 7: 100, 8: 90}
SINGLES = {
    1: ("photo", "candidate", 8, "medium"), 3: ("screenshot", "neutral", 4, "high"),
    4: ("photo", "reject", 1, "high"), 5: ("photo", "reject", 3, "low"),
    6: ("photo", "candidate", 9, "high"), 7: ("photo", "candidate", 10, "high"),
    8: ("photo", "neutral", 8, "medium"),
}


def documents(spark):
    rows = []
    for k in range(9):
        at = f"2024-06-01T10:00:{2 * k:02d}.000Z" if k < 3 else f"2024-06-01T{9 + k:02d}:00:00.000Z"
        make, model = ("Canon", "EOS R6") if k < 3 else ("Apple", "iPhone 13")
        rows.append(json.dumps({"id": str(k), "type": "IMAGE", "fileCreatedAt": at, "exifInfo": {
            "make": make, "model": model, "dateTimeOriginal": at}}))
    df = spark.createDataFrame([(r,) for r in rows], "j string")
    return df.select(F.from_json("j", ASSET_DOCUMENT).alias("d")).select("d.*")


def ask_burst(row):
    q = [QUALITY[int(m)] for m in row["member_ids"]]
    best = q.index(max(q))
    return {"text": json.dumps({"best_index": best + 1, "note": "sharpest", "reject_indices": [
        i + 1 for i in range(len(q)) if i != best]}), "input_tokens": 10}


def ask_single(row):
    c, v, s, conf = SINGLES[int(row["id"])]
    return {"text": json.dumps({"category": c, "verdict": v, "technical_score": s,
                                "confidence": conf, "reasons": ["r"]})}


def ask_set(row):
    q = [QUALITY[int(m)] for m in row["member_ids"]]
    return {"text": json.dumps({"best_index": q.index(max(q)) + 1,
                                "worst_index": q.index(min(q)) + 1, "note": ""})}


def ask_pair(row):
    a, b = int(row["a_id"]), int(row["b_id"])
    win = "A" if {a, b} == {7, 8} or QUALITY[a] > QUALITY[b] else "B"
    return {"text": json.dumps({"winner": win, "note": ""})}


JUDGES = {"burst": ask_burst, "triage": ask_single, "bws": ask_set, "pair": ask_pair}


class Seen:
    counters = None


@pytest.fixture(scope="module")
def first(spark):
    tables = {**empty_tables(spark), "assets": flatten_assets(documents(spark))}
    options = Options(finals_rounds=2, five_count=2, four_frac=0.5, album="", write_captions=False,
                      fit_tol=1e-4)
    Seen.counters = cycle.Counters()
    out, plan = cycle.run_cycle(tables, JUDGES, options, now=NOW, counters=Seen.counters)
    return out, plan, options


def counted(df, column):
    return {r[0]: r[1] for r in df.groupBy(column).count().collect()}


def test_counters_of_the_first_run(first):
    rows = {r.stage: tuple(r)[1:] for r in Seen.counters.table().collect()}
    assert rows["burst"] == (1, 1, 0, 10, 0)
    assert rows["triage"] == (7, 7, 0, 0, 0)
    assert rows["bws"][:3] == (4, 4, 0)
    assert all(asked == judged and asked % 2 == 0 for s, (asked, judged, *_) in rows.items() if s.startswith("finals"))


def test_failed_calls_are_counted(spark):
    def refuse(row):
        raise ValueError("no picture")

    tables = {**empty_tables(spark), "assets": flatten_assets(documents(spark)).filter("id in ('4', '5')")}
    counters = cycle.Counters()
    out = cycle.triage_stage(tables, {**JUDGES, "triage": refuse}, F.lit(NOW), counters)
    rows = {r.stage: tuple(r)[1:] for r in counters.table().collect()}
    assert rows == {"burst": (0, 0, 0, 0, 0), "triage": (2, 0, 2, 0, 0)} and out["triage"].isEmpty()


def test_bands_from_the_pool_without_outcomes(spark):
    scores = spark.createDataFrame([(f"s{i}", float(i)) for i in range(4)], "asset_id string, bt_score double")
    tables = {**empty_tables(spark), "scores": align(scores, SCORES)}
    out = cycle.finals_stage(tables, JUDGES, Options(finals_rounds=0, five_count=1, four_frac=0.5), F.lit(NOW))
    assert {r.asset_id: r.stars for r in out["scores"].collect()} == {"s3": 5, "s2": 4, "s1": None, "s0": None}


def test_first_run(first):
    t, plan, _ = first
    assert [(r.winner_id, r.reject_ids) for r in t["bursts"].collect()] == [("1", ["0", "2"])]
    assert t["triage"].count() == 7
    buckets = {r.asset_id: r.bucket for r in t["decisions"].collect()}
    assert {k for k, v in buckets.items() if v == "reject"} == {"4"}
    assert {k for k, v in buckets.items() if v == "nonphoto"} == {"3"}
    assert {k for k, v in buckets.items() if v == "burst_loser"} == {"0", "2"}
    assert counted(t["decisions"], "bucket") | {"middle": 1} == {
        "reject": 1, "nonphoto": 1, "burst_loser": 2, "five_star": 2, "four_star": 1, "middle": 1}
    assert buckets["7"] == "five_star"
    assert t["bws_sets"].count() == 4
    ranks = {r.asset_id: r.rank for r in t["scores"].collect()}
    assert set(ranks) == {"1", "6", "7", "8"} and ranks["7"] == 1
    assert max(ranks.values()) == ranks["1"]
    pairs = t["pairs"].collect()
    assert [r.winner for r in pairs if {r.a_id, r.b_id} == {"7", "8"}] == ["tie"]
    assert counted(plan, "bucket") == {"burst_loser": 2, "five_star": 2, "reject": 1,
                                       "nonphoto": 1, "four_star": 1, "burst_stack": 1}
    stack = plan.filter("bucket = 'burst_stack'").first()
    assert stack.ops[0].asset_ids == ["1", "0", "2"]
    got = {r.label: r.value for r in report.report_summary(t).collect()}
    assert (got["Assets scanned"], got["Triaged"], got["Awaiting triage"], got["Burst groups"],
            got["Best-worst sets"], got["Decisions written back"]) == (9, 7, 2, 1, 4, 0)


def test_second_run_makes_no_new_work(first):
    t, _, options = first

    def never(row):
        raise FatalJudgeError("judged again")

    again, _ = cycle.run_cycle(t, {**JUDGES, "burst": never, "triage": never, "bws": never},
                               options, now=NOW)
    assert again["bws_sets"].count() == 4 and again["triage"].count() == 7
    seen = [frozenset((r.a_id, r.b_id)) for r in again["pairs"].collect()]
    assert len(seen) == len(set(seen))


def test_judge_retries_only_unusable_replies(spark, tmp_path):
    log = str(tmp_path / "calls")

    def fn(row):
        with open(log, "a") as f:
            f.write(f"{row['k']}\n")
        return {1: {"text": '{"winner": "A", "note": "n"}', "input_tokens": 3},
                2: {"text": "no"}, 3: {"text": "{", "stop_reason": "max_tokens"}}.get(row["k"]) or {}

    out = judging.judge_with(spark.createDataFrame([(1,), (2,), (3,)], "k int"), fn, "pair")
    rows = {r.k: r for r in out.collect()}
    assert rows[1].error is None and rows[1].input_tokens == 3
    assert rows[2].error and rows[3].error.startswith("stopped")
    calls = sorted(int(x) for x in open(log))
    assert calls == [1, 2, 2, 3]

    def fatal(row):
        raise FatalJudgeError("credential rejected")

    with pytest.raises(Exception, match="credential rejected"):
        judging.judge_with(spark.createDataFrame([(1,)], "k int"), fatal, "pair").collect()


def test_stream_closes_only_finished_chains(spark, tmp_path):
    path = str(tmp_path)
    schema = stream_ops.FRAME

    def arrive(*rows):
        spark.createDataFrame(
            [(i, datetime(2024, 6, 1, 10, 0, s, tzinfo=UTC), "C", None) for i, s in rows], schema
        ).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{path}/in")
        stream_ops.stream_bursts(stream, path, gap_seconds=5, lateness_seconds=0).awaitTermination()
        return sorted(r.id for r in stream_ops.emitted_groups(spark, path).collect())

    assert arrive(("a", 0), ("b", 4)) == []
    assert arrive(("c", 8), ("x", 14)) == ["a", "b", "c"]
    assert arrive(("y", 18), ("late", 1)) == ["a", "b", "c"]
    assert sorted(r.id for r in stream_ops.open_groups(spark, path, 2, 5).collect()) == ["x", "y"]


def test_watch_and_results_in_two_batches_equal_one(spark, tmp_path):
    assets = flatten_assets(documents(spark))
    path = str(tmp_path)

    def step(rows):
        rows.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(assets.schema).parquet(f"{path}/in")
        run = watching.watch(stream, path, once=True)
        run.awaitTermination()
        return watching.latest(spark, path)

    assert step(assets.filter("id < '4'"))["assets"].count() == 4
    assert step(assets.limit(0))["assets"].count() == 4  # a start without rows keeps the tables
    both = step(assets)
    assert sorted(r.id for r in both["assets"].collect()) == [str(k) for k in range(9)]
    assert worklists.unjudged(both["assets"], both["triage"]).count() == 9
    items = spark.createDataFrame([("triage_4", "q", "{}"), ("triage_6", "q", "{}")],
                                  "custom_id string, batch_id string, payload string")
    i, b = register_batch(both["batch_items"], both["batches"], items, "triage", F.lit(NOW))
    save_tables({**both, "batch_items": i, "batches": b}, f"{path}/start")
    reply = ask_single({"id": "4"})["text"]
    feed = "custom_id string, reply string, error string"
    for rows in ([("triage_4", reply, None), ("triage_4", None, "twice")],
                 [("triage_4", ask_single({"id": "6"})["text"], None), ("triage_6", None, "bad")]):
        spark.createDataFrame(rows, feed).write.mode("append").parquet(f"{path}/results")
        run = watching.stream_results(
            spark.readStream.schema(feed).parquet(f"{path}/results"), f"{path}/r", f"{path}/start",
            once=True)
        run.awaitTermination()
    end = watching.latest(spark, f"{path}/r")
    assert {r.asset_id: r.bucket for r in end["decisions"].collect()} == {"4": "reject"}
    assert {r.custom_id: r.error for r in end["batch_items"].collect()} == {
        "triage_4": None, "triage_6": "bad"}
    assert actions.asset_actions(end["decisions"]).count() == 1


def test_closing_chains_joins_no_frames(spark, tmp_path, monkeypatch):
    tables = []
    monkeypatch.setattr(stream_ops, "attach", lambda fact, stats, *a, **k: tables.append(
        stats.count()) or skew.attach(fact, stats, *a, **k))
    path = str(tmp_path)
    rows = [(f"{c}{k:02d}", datetime(2024, 6, 1, 10, k, 0, tzinfo=UTC), c, None)
            for c in "ab" for k in range(30)]
    spark.createDataFrame(rows, stream_ops.FRAME).coalesce(1).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(stream_ops.FRAME).parquet(f"{path}/in")
    stream_ops.stream_bursts(stream, path, gap_seconds=61).awaitTermination()
    assert tables == [2]  # the open chains alone: one per camera
    assert spark.read.parquet(f"{path}/open/0").count() == 60
    assert stream_ops.open_groups(spark, path, 0, 61).count() == 60


def test_results_come_in_four_micro_batches(spark, tmp_path, monkeypatch):
    docs = [(k, f"text {k}", 10 + k) for k in range(80)]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(80)], "doc_id long, quality long, toxic long").repartition(
        8).write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(registry, "cut", lambda df: cut(df.repartition(8)))
    places = []
    workspace = registry._workspace
    monkeypatch.setattr(registry, "_workspace", lambda s: places.append(workspace(s)) or places[-1])
    registry.stream_results(spark, str(tmp_path))
    assert len(spark.read.parquet(f"{places[0]}/in").inputFiles()) >= 16
    assert len(versions(spark, f"{places[0]}/tables")) <= 5


def test_replies_go_to_python_in_small_batches(spark):
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(bound)
    parse_replies(spark.createDataFrame([("x",)], "reply string"), "pair")
    assert spark.conf.get(bound) == f"{8 << 20}b"


def test_replies_are_read_once_and_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(judging, "ASKED_PER_TASK", 10)

    def fn(row):
        from pyspark import TaskContext

        text = "no verdict" if row["k"] == 7 else '{"winner": "A", "note": "n"}'
        return {"text": text, "input_tokens": TaskContext.get().partitionId() + 1, "output_tokens": 1}

    out = judging.judge_with(spark.range(45).select(F.col("id").alias("k")).coalesce(1), fn, "pair")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Scan parquet" in plan
    rows = {r.k: r for r in out.collect()}
    assert sorted(rows) == list(range(45))
    assert [k for k, r in rows.items() if r.error is not None] == [7]
    assert all(r.winner == "A" for k, r in rows.items() if k != 7)
    assert len({r.input_tokens for k, r in rows.items() if k != 7}) > 1
