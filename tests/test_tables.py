import json
import struct
import time
import zlib
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from pickline.operators import actions, bands, judging, merges, packing, report, worklists
from pickline.schemas import ASSETS, BURSTS, DECISIONS, SCORES, TABLES, TRIAGE, align, empty_tables
from pickline.session import cut
from pickline.sources import assets as sources
from pickline.sources.images import hash_images
from pickline.sources.tables import load_tables, save_tables, write_actions



def now():
    return F.lit(datetime(2024, 7, 1, tzinfo=UTC))


OLD = datetime(2024, 1, 1, tzinfo=UTC)


def rows(spark, schema, *dicts):
    return spark.createDataFrame([tuple(d.get(n) for n in schema.names) for d in dicts], schema)


def triage(spark, *verdicts):
    return rows(spark, TRIAGE, *[
        {"asset_id": a, "category": c, "verdict": v, "technical_score": s} for a, c, v, s in verdicts])


def test_candidates(spark):
    t = triage(spark, ("a1", "photo", "candidate", 4), ("a2", "photo", "neutral", 9),
               ("a3", "photo", "neutral", 7), ("a4", "screenshot", "candidate", 10),
               ("a5", "photo", "candidate", 9), ("a6", "photo", "candidate", 9),
               ("a7", "photo", "neutral", 8))
    d = rows(spark, DECISIONS, {"asset_id": "a5", "bucket": "burst_loser"},
             {"asset_id": "a6", "bucket": "reject"}, {"asset_id": "a7", "bucket": "middle"})
    assert [r.asset_id for r in worklists.candidates(t, d).collect()] == ["a2", "a7", "a1"]


def test_rejudge_and_forget(spark):
    when = {"cap1": 1, "cap2": 2, "old1": 3, "old2": 4}
    a = rows(spark, ASSETS, *[{"id": k, "taken_at": datetime(2024, m, 15, tzinfo=UTC),
                               "burst_id": "b1" if k == "old1" else None} for k, m in when.items()])
    t = rows(spark, TRIAGE, *[{"asset_id": k, "caption": "c" if k[0] == "c" else None}
                              for k in when])
    d = rows(spark, DECISIONS, {"asset_id": "cap1", "bucket": "reject"})

    def ids(**options):
        got = worklists.rejudge_targets(a, t, d, **options)
        return sorted(r.asset_id for r in got.collect())

    assert ids(missing_captions=True) == ["old1", "old2"]
    assert ids(bucket="reject") == ["cap1"]
    assert ids(after="2024-03-01") == ["old1", "old2"]
    assert ids(before="2024-02-01") == ["cap1"]
    b = rows(spark, BURSTS, {"burst_id": "b1"}, {"burst_id": "b2"})
    t2, b2 = worklists.forget_triage(t, b, a, worklists.rejudge_targets(
        a, t, d, missing_captions=True))
    assert sorted(r.asset_id for r in t2.collect()) == ["cap1", "cap2"]
    assert [r.burst_id for r in b2.collect()] == ["b2"]


def test_summary(spark):
    t = empty_tables(spark)
    t["assets"] = rows(spark, ASSETS, *[{"id": f"a{i}", "burst_id": "b1" if i > 3 else None}
                                        for i in range(1, 6)])
    t["triage"] = triage(spark, ("a1", "photo", "candidate", 9), ("a2", "photo", "reject", 2),
                         ("a3", "screenshot", "neutral", 5))
    t["decisions"] = rows(
        spark, DECISIONS, {"asset_id": "a2", "bucket": "reject", "applied_at": OLD},
        {"asset_id": "a3", "bucket": "nonphoto"}, {"asset_id": "a5", "bucket": "burst_loser"})
    t["batch_items"], t["batches"] = merges.register_batch(
        t["batch_items"], t["batches"], spark.createDataFrame(
            [("triage_a1", "b1", "{}"), ("triage_a2", "b1", "{}")],
            "custom_id string, batch_id string, payload string"), "triage", now())
    got = {r.metric: r.value for r in report.summary(t).collect()}
    assert {k: got[k] for k in ("assets", "triage", "burst_groups", "untriaged", "applied",
                                "unapplied", "open_batches", "batch_items", "pairs")} == {
        "assets": 5, "triage": 3, "burst_groups": 1, "untriaged": 2, "applied": 1, "unapplied": 2,
        "open_batches": 1, "batch_items": 2, "pairs": 0}


def test_stamps(spark):
    d = rows(spark, DECISIONS, {"asset_id": "a", "bucket": "reject", "applied_at": OLD},
             {"asset_id": "b", "bucket": "reject", "applied_at": OLD})
    new = spark.createDataFrame([("a", "reject"), ("b", "middle"), ("c", "middle")],
                                "asset_id string, bucket string")
    got = {r.asset_id: r.applied_at for r in merges.merge_decisions(d, new).collect()}
    assert got["a"] is not None and got["b"] is None and got["c"] is None
    b = rows(spark, BURSTS, *[{"burst_id": k, "winner_id": "w", "reject_ids": ["x", "y"],
                               "applied_at": OLD} for k in "pq"])
    new = rows(spark, BURSTS, {"burst_id": "p", "winner_id": "w", "reject_ids": ["x", "y"]},
               {"burst_id": "q", "winner_id": "w", "reject_ids": ["y", "x"]})
    got = {r.burst_id: r.applied_at for r in merges.merge_bursts(b, new).collect()}
    assert got["p"] is not None and got["q"] is None


def test_upsert_keeps_absent_columns_and_last_row(spark):
    a = rows(spark, ASSETS, {"id": "x", "camera": "c", "burst_id": "b"})
    u = spark.createDataFrame([("x", 3, 1), ("x", 5, 2), ("y", 1, 1)],
                              "id string, source_rating int, seq int")
    got = {r.id: (r.camera, r.burst_id, r.source_rating)
           for r in merges.merge_upsert(a, u, "id", "seq").collect()}
    assert got == {"x": ("c", "b", 5), "y": (None, None, 1)}


def test_rejudged_burst_promotes_a_member(spark):
    g = spark.createDataFrame([("b", ["m0", "m1", "m2"])], "burst_id string, member_ids array<string>")
    v = spark.createDataFrame([("b", 1, [3, 3, 1, 9], "n")],
                              "burst_id string, best_index int, reject_indices array<int>, note string")
    d = rows(spark, DECISIONS, *[{"asset_id": m, "bucket": "burst_loser", "applied_at": OLD}
                                 for m in ("m0", "m2")])
    b, d2, failed = merges.resolve_bursts(g, v, rows(spark, BURSTS), d, now())
    assert [(r.winner_id, r.reject_ids) for r in b.collect()] == [("m0", ["m2"])]
    assert [(r.asset_id, r.bucket) for r in d2.collect()] == [("m2", "burst_loser")]
    assert failed.isEmpty()


def test_shrunk_group_is_a_pending_single(spark):
    t = empty_tables(spark)
    a = rows(spark, ASSETS, {"id": "solo", "burst_id": "b-lonely"})
    args = (t["batch_items"], t["batches"])
    assert worklists.pending_bursts(a, t["bursts"], *args).isEmpty()
    got = worklists.pending_singles(a, t["triage"], t["bursts"], *args).collect()
    assert [r.id for r in got] == ["solo"]


def test_bands(spark):
    ranked = spark.createDataFrame([(f"i{k:02d}", 100.0 - k) for k in range(40)],
                                   "asset_id string, bt_score double")
    first = ranked.filter("bt_score > 90")
    got = [r.stars for r in bands.star_bands(first, 2, 0.3).orderBy("position").collect()]
    assert got == [5, 5, 4, 4] + [None] * 6
    stars = [r.stars for r in bands.fraction_bands(ranked).collect()]
    assert (stars.count(5), stars.count(4)) == (2, 6)
    assert bands.star_bands(first, 99, 2.0).filter("stars = 5").count() == 10


def test_anchors(spark):
    cands = spark.createDataFrame([(f"n{k}",) for k in range(5)] + [(f"s{k}",) for k in range(10)],
                                  "asset_id string")
    scores = rows(spark, SCORES, *[{"asset_id": f"s{k}", "bt_score": 10.0 - k} for k in range(10)])

    def ids(limit):
        return {r.asset_id for r in bands.cap_candidates(cands, scores, limit).collect()}

    fresh = {f"n{k}" for k in range(5)}
    assert ids(3) == fresh | {"s0", "s4", "s9"}
    assert ids(1) == fresh | {"s0"}
    assert len(ids(0)) == len(ids(50)) == 15


def test_reconcile_stamps_a_decision_only_by_its_own_action(spark):
    t = empty_tables(spark)
    t["assets"] = rows(spark, ASSETS, {"id": "a"}, {"id": "b"})
    t["triage"] = rows(spark, TRIAGE, {"asset_id": "a", "caption": "x"},
                       {"asset_id": "b", "caption": "y"})
    t["decisions"] = rows(spark, DECISIONS, {"asset_id": "a", "bucket": "reject"},
                          {"asset_id": "b", "bucket": "four_star"})
    plan = actions.select_groups(actions.plan(t), "enrich,reject")
    ops = actions.exploded_ops(plan).withColumn("ok", F.lit(True))
    done = actions.reconcile(plan, ops.select("stage", "sort_key", "op_no", "ok"))
    assert [r.asset_id for r in done["decisions"].collect()] == ["a"]
    assert sorted(r.asset_id for r in done["enriched"].collect()) == ["a", "b"]
    failed = ops.select("stage", "sort_key", "op_no", (F.col("op") != "tag").alias("ok"))
    done = actions.reconcile(plan, failed)
    assert done["decisions"].isEmpty()
    assert [r.asset_id for r in done["enriched"].collect()] == ["b"]
    for junk in ("", "nope", set()):
        with pytest.raises(ValueError):
            actions.select_groups(plan, junk)


def test_packing(spark):
    items = spark.createDataFrame([(f"k{i:03d}", (i * 37) % 90 + (500 if i % 50 == 0 else 0))
                                   for i in range(400)], "custom_id string, bytes long")
    out = packing.pack_batches(items, 9, 300, partitions=3).collect()
    assert len(out) == 400
    sizes = {}
    for r in out:
        sizes.setdefault(r.batch_id, []).append(r.bytes)
    assert all(len(s) <= 9 and (sum(s) <= 300 or len(s) == 1) for s in sizes.values())


def test_tables_round_trip(spark, tmp_path):
    t = empty_tables(spark)
    t["scores"] = rows(spark, SCORES, {"asset_id": "a", "bt_score": 1.5, "rank": 1})
    save_tables(t, f"{tmp_path}/v1")
    back = load_tables(spark, f"{tmp_path}/v1")
    assert [r.bt_score for r in back["scores"].collect()] == [1.5]
    t["scores"].select("asset_id").write.parquet(f"{tmp_path}/v0/scores")
    with pytest.raises(FileNotFoundError):  # tables, but no listing: not written to the end
        load_tables(spark, f"{tmp_path}/v0")
    with pytest.raises(FileNotFoundError):
        load_tables(spark, f"{tmp_path}/none")
    save_tables({"scores": t["scores"]}, f"{tmp_path}/v2", kept={"scores": f"{tmp_path}/v0/scores"})
    old = load_tables(spark, f"{tmp_path}/v2")
    assert {n: df.schema.names for n, df in old.items()} == {n: s.names for n, s in TABLES.items()}
    assert old["scores"].first().stars is None
    t["decisions"] = rows(spark, DECISIONS, {"asset_id": "a", "bucket": "reject"})
    write_actions(actions.plan(t), f"{tmp_path}/plan", dry_run=False)
    assert [r.group for r in spark.read.parquet(f"{tmp_path}/plan").collect()] == ["reject"]


def test_read_assets(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join([
        '{"id": "x", "type": "IMAGE", "fileCreatedAt": "2024-06-01T10:00:00.000Z", '
        '"exifInfo": {"make": " Canon ", "rating": 4, "description": ""}, "rating": 1}',
        '{"id": "v", "type": "VIDEO"}', '{"type": "IMAGE"}', '{"id": "y", "rating": 2}']))
    got = {r.id: r for r in sources.read_assets(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["x", "y"]
    assert (got["x"].camera, got["x"].source_rating, got["x"].description) == ("Canon|", 4, None)
    assert (got["y"].camera, got["y"].source_rating, got["y"].taken_at) == ("", 2, None)
    assert align(spark.range(1), ASSETS).schema.names == ASSETS.names


def test_documents_outside_the_window_are_not_read(spark, tmp_path):
    path = str(tmp_path / "documents")
    spark.createDataFrame([(f"a{i}", f"2024-06-{i + 1:02d}T2{i % 4}:30:00Z") for i in range(20)] + [("none", None)],
                          "id string, fileCreatedAt string").select(
        "id", "fileCreatedAt", *[F.lit(None).cast("string").alias(c) for c in ("type", "localDateTime", "originalFileName")],
        F.lit(1).alias("rating"), F.lit(None).cast("bigint").alias("dhash"), F.lit(None).cast("string").alias("thumb_path"),
        F.lit(None).cast("struct<make:string, model:string, exifImageWidth:int, exifImageHeight:int, "
                         "dateTimeOriginal:string, rating:int, description:string>").alias("exifInfo"),
    ).transform(lambda df: sources.write_documents(df, path, "parquet") or df)
    for file in (tmp_path / "documents" / "day=2024-06-01").glob("*.parquet"):
        file.write_bytes(b"not a table")  # reading it is an error
    got = sources.read_assets(spark, path, "parquet", after="2024-06-05", before="2024-06-07T22:00:00Z")
    assert sorted(r.id for r in got.collect()) == ["a4", "a5"]
    assert "PartitionFilters: [isnotnull(day" in got._jdf.queryExecution().executedPlan().toString()


def png(path, pixels):
    raw = b"".join(b"\0" + bytes(line) for line in pixels)

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    head = struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 0, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(
        b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_hashes(spark, tmp_path):
    png(tmp_path / "down.png", [[250 - 10 * x for x in range(18)] for _ in range(16)])
    png(tmp_path / "up.png", [[10 * x for x in range(18)] for _ in range(16)])
    (tmp_path / "junk.png").write_bytes(b"junk")
    got = {r.path.rsplit("/", 1)[1]: r.dhash for r in hash_images(spark, str(tmp_path)).collect()}
    assert got == {"down.png": -1, "up.png": 0, "junk.png": None}


def test_small_items_fill_one_batch(spark):
    items = spark.range(1000).select(F.concat(F.lit("w"), "id").alias("custom_id"),
                                     F.lit(2400).alias("bytes"))
    assert packing.pack_batches(items).select("batch_id").distinct().count() == 1
    assert packing.pack_batches(items.limit(0)).isEmpty()


def queued(spark, *ids):
    items = spark.createDataFrame([(i, "q", "{}") for i in ids],
                                  "custom_id string, batch_id string, payload string")
    t = empty_tables(spark)
    i, b = merges.register_batch(t["batch_items"], t["batches"], items, "triage",
                                 F.lit(datetime(2024, 6, 1, tzinfo=UTC)))
    return {**t, "batch_items": i, "batches": b}


def reply(score):
    return json.dumps({"category": "photo", "verdict": "neutral", "technical_score": score,
                       "reasons": ["r"], "confidence": "low"})


def ingest(spark, tables, *results, **options):
    got = spark.createDataFrame(results, "custom_id string, reply string, error string")
    return judging.ingest_results(got, tables, F.lit(datetime(2024, 6, 2, tzinfo=UTC)), **options)[0]


def test_a_batch_closes_with_its_last_outcome(spark):
    t = queued(spark, "triage_a", "triage_b")
    part = ingest(spark, t, ("triage_a", reply(3), None))
    assert [r.custom_id for r in worklists.inflight(part["batch_items"], part["batches"]).collect()
            if r.custom_id == "triage_b"] == ["triage_b"]
    assert part["batches"].first().status == "submitted"
    whole = ingest(spark, part, ("triage_b", None, "failed"))
    assert whole["batches"].first().status == "ingested"
    ended = ingest(spark, t, ("triage_a", reply(3), None), ended=True)
    assert ended["batches"].first().status == "ingested"


def test_repeated_results_keep_one_row_per_key(spark):
    t = queued(spark, "triage_a", "triage_b")
    after = ingest(spark, t, ("triage_a", reply(3), None), ("triage_a", reply(4), None),
                   ("triage_a", None, "late"), ("triage_b", None, "x"), ("triage_b", None, None))
    assert [(r.asset_id, r.technical_score) for r in after["triage"].collect()] == [("a", 4)]
    assert after["decisions"].count() == 1
    assert sorted(r.custom_id for r in after["batch_items"].collect()) == ["triage_a", "triage_b"]


def test_upserts_keep_keys_unique_without_an_order(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    updates = spark.createDataFrame([("a", 5), ("a", 7), ("c", None), ("c", 3)], "k string, v int")
    got = sorted(map(tuple, merges.merge_upsert(target, updates, "k").collect()))
    assert got == [("a", 7), ("b", 2), ("c", 3)]


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_small_updates_shuffle_few_rows(spark, kind):
    target = spark.range(100_000).select(F.col("id").cast(kind).alias("k"), F.col("id").alias("v"), F.lit("kept").alias("w"))
    updates = spark.range(99_990, 100_010).select(F.col("id").cast("int" if kind == "bigint" else kind).alias("k"), (-F.col("id")).alias("v"))
    near, rest = merges.split_by_filter(target, updates, "k")
    assert 10 <= near.count() <= 10 + 100 and near.count() + rest.count() == 100_000
    assert near.filter("v >= 99990").count() == 10  # no key of an update is missed
    for part in (near, rest):  # only the filter is exchanged, and only by broadcast to the rows
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert "Exchange hashpartitioning(key" not in plan and "Exchange hashpartitioning(k" not in plan
    merged = merges.merge_upsert(target, updates, "k")
    assert merged.count() == 100_010
    got = {r.k: (r.v, r.w) for r in merged.filter("v < 0 or v in (0, 99989)").collect()}
    of = str if kind == "string" else int
    assert got == {of(i): (-i, "kept" if i < 100_000 else None) for i in range(99_990, 100_010)} | {
        of(0): (0, "kept"), of(99_989): (99_989, "kept")}


def test_cut_leaves_no_shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {name for name in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in name}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, given = shuffles(), spark.conf.get(setting)
    made = cut(spark.range(20_000).repartition(3, "id").groupBy(F.col("id") % 7).count())
    ended = time.time() + 20
    while shuffles() - before and time.time() < ended:
        time.sleep(0.2)
    assert not shuffles() - before
    assert made.count() == 7 and spark.conf.get(setting) == given


def test_updates_of_everything_and_of_nothing(spark):
    target = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, v int")
    none = target.limit(0)
    assert sorted(merges.merge_upsert(target, none, "k").collect(), key=repr) == sorted(target.collect(), key=repr)
    assert sorted(merges.merge_upsert(none, target, "k").collect(), key=repr) == sorted(target.collect(), key=repr)
    many = spark.range(300_000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"))
    merged = merges.merge_upsert(many, many.withColumn("v", F.lit(2)), "k")
    assert merged.agg(F.count("*"), F.sum("v")).first()[:] == (300_000, 600_000)


def test_the_tail_leaves_exempt_photos_alone(spark):
    triage = rows(spark, TRIAGE, *[{"asset_id": a, "category": "photo", "technical_score": 6}
                                   for a in "ab"])
    none = spark.createDataFrame([], "asset_id string, bucket string, stars int")
    five = spark.createDataFrame([("a",)], "asset_id string")
    tail = bands.star_tail(triage, none, none, exempt=five)
    assert [(r.asset_id, r.stars) for r in tail.collect()] == [("b", 2)]


def test_small_batches_share_tasks(spark):
    items = spark.range(3_000).select(F.col("id").cast("string").alias("custom_id"), F.lit(10).cast("long").alias("bytes"))
    packed = packing.pack_batches(items, 5, 1_000)
    assert packed.rdd.getNumPartitions() < 10  # 75 parts of eight batches
    rows = packed.collect()
    parts = {r.batch_id.split(".")[0] for r in rows}
    assert len(parts) == 75
    held = {}
    for r in rows:
        held.setdefault(r.batch_id, []).append(r.custom_id)
    assert max(map(len, held.values())) == 5 and len(held) <= 600 + len(parts)
    spread = items.repartition(75, "custom_id").withColumn("part", F.spark_partition_id())
    assert {r.custom_id: f"p{r.part}" for r in spread.collect()} == {r.custom_id: r.batch_id.split(".")[0] for r in rows}
