import json

import pytest
from pyspark.sql import functions as F

from pickline.functions import replies as R
from pickline.functions import scalars as S


def values(spark, rows, schema, expr):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
    return [r[0] for r in df.orderBy("_i").select(expr).collect()]


def test_scalars(spark):
    texts = ["90s", "30m", "6h", "7d", "1w", "45", " 2H ", "0s", "-3m", "x", "", "1.5h"]
    assert values(spark, [(t,) for t in texts], "t string", S.interval_seconds(F.col("t"))) == [
        90, 1800, 21600, 604800, 604800, 45, 7200, None, None, None, None, 5400]
    assert [S.interval_literal(t) for t in texts[:7]] == [90, 1800, 21600, 604800, 604800, 45, 7200]
    for junk in ("", "x", "0", "-1h"):
        with pytest.raises(ValueError):
            S.interval_literal(junk)
    words = [(["Beach", " beach ", "Golden  Retriever", "", " Fog "],),
             ([str(i) for i in range(12)],)]
    assert values(spark, words, "w array<string>", S.normalize_keywords(F.col("w"))) == [
        ["beach", "golden retriever", "fog"], [str(i) for i in range(8)]]
    grids = [([1.0] * 72,), ([float(i % 9) for i in range(72)],),
             ([float(-(i % 9)) for i in range(72)],), ([1.0],)]
    assert values(spark, grids, "g array<double>", S.dhash_bits(F.col("g"))) == [0, 0, -1, None]
    assert values(spark, [(0, -1), (5, 5)], "a long, b long",
                  S.hamming(F.col("a"), F.col("b"))) == [64, 0]
    cams = [(" A ", None), (None, " "), ("A", "B"), (None, "B")]
    assert values(spark, cams, "a string, b string",
                  S.camera_key(F.col("a"), F.col("b"))) == ["A|", "", "A|B", "|B"]


def test_capture_time(spark):
    rows = [("2024-06-01T10:00:00.000Z", None), ("junk", "2024-06-01"),
            (None, "2024-06-01T10:00:00+02:00"), ("2024-06-01 10:00", None), ("", "nope"),
            ("2024-13-01", "2024-06-01T10:00:00")]
    got = values(spark, rows, "a string, b string",
                 F.date_format(S.capture_time(F.col("a"), F.col("b")), "dd HH:mm"))
    assert got == ["01 10:00", "01 00:00", "01 08:00", "01 10:00", None, "01 10:00"]


def test_work_ids(spark):
    rows = [("triage", "a-1"), ("burst", "b_2"), ("zip", "c"), ("pair", "x:y"), ("bws", "z" * 70)]
    made = values(spark, rows, "k string, i string", S.make_work_id(F.col("k"), F.col("i")))
    assert made == ["triage_a-1", "burst_b_2", "zip_c", None, None]
    kinds = values(spark, [(m,) for m in made[:3]], "w string",
                   S.work_kind(F.col("w"), F.lit("triage")))
    assert kinds == ["triage", "burst", "triage"]
    assert values(spark, [(m,) for m in made[:3]], "w string", S.work_key(F.col("w"))) == [
        "a-1", "b_2", "zip_c"]


def test_three_decimals(spark):
    nums = [0.9005, 0.0005, 0.0625, 1.2345, 2.0, 0.1235, 3.9995, 10.00049999, 0.0015, 123.4565]
    got = values(spark, [(v,) for v in nums], "v double", S.three_decimals(F.col("v")))
    assert got == [f"{v:.3f}" for v in nums]


def test_replies(spark):
    good = '{"best_index": 1, "reject_indices": [2, "3"], "note": "a } in {text} \\" ok"}'
    rows = [(good,), (f"```json\n{good}\n``` {{}}",), ("no object",), ('{"best_index": 1',), (None,),
            ('{"best_index": "x", "reject_indices": [], "note": ""}',),
            ('{"best_index": 1.5, "reject_indices": [], "note": ""}',), ("{bad json}",),
            ('[{"best_index": 2.0, "reject_indices": [], "note": "n"}]',)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, reply string")
    out = R.parse_replies(df, "burst").orderBy("i").collect()
    assert [r.error is None for r in out] == [
        True, True, False, False, False, False, False, False, True]
    assert out[1].reject_indices == [2, 3] and out[1].note == 'a } in {text} " ok'
    assert out[8].best_index == 2


def test_validation(spark):
    rows = [(1, [2, 3]), (0, [1]), (4, []), (2, [2]), (1, [9])]
    df = spark.createDataFrame(rows, "best_index int, reject_indices array<int>")
    valid, rejected = R.validate_verdicts(df, "burst", F.lit(3))
    assert [r.best_index for r in valid.collect()] == [1] and rejected.count() == 4
    loose, _ = R.validate_verdicts(df, "burst", F.lit(3), strict=False)
    assert loose.count() == 3


@pytest.mark.parametrize(("change", "error"), [
    ({}, None),
    ({"reasons": [1]}, "wrong type of reasons"),
    ({"reasons": []}, None),
    ({"reasons": [None]}, "wrong type of reasons"),
    ({"caption": None}, "wrong type of caption"),
    ({"caption": 7}, "wrong type of caption"),
    ({"caption": "a \\ \" } {"}, None),
    ({"keywords": None}, "wrong type of keywords"),
    ({"technical_score": "8"}, None),
    ({"technical_score": 8.0}, None),
    ({"technical_score": "8d"}, "missing or unusable technical_score"),
    ({"technical_score": "1e1"}, "missing or unusable technical_score"),
    ({"technical_score": 10 ** 30}, "missing or unusable technical_score"),
])
def test_replies_of_wrong_types(spark, change, error):
    good = {"category": "photo", "verdict": "neutral", "technical_score": 8, "reasons": ["r"],
            "confidence": "low"}
    df = spark.createDataFrame([("so: " + json.dumps(good | change) + " }",)], "reply string")
    row = R.parse_replies(df, "triage").first()
    assert row.error == error
    assert error or row.technical_score == 8


def test_plain_replies_stay_out_of_python(spark, monkeypatch):
    seen_nothing = F.pandas_udf(lambda texts: texts.where(texts.isna(), None), "string")
    replies = [' {"winner": "A", "note": "a } in text"}\n', '{"winner": "B", "note": "x", "more": {"y": [1, {}]}}',
               'Sure: {"winner": "A", "note": "n"}', '["winner"]', '{"winner": "A", "note": "n"} and more', None]
    df = spark.createDataFrame(list(enumerate(replies)), "i int, reply string")
    as_before = [(r.winner, r.error is None) for r in R.parse_replies(df, "pair").orderBy("i").collect()]
    assert as_before == [("A", True), ("B", True), ("A", True), (None, False), ("A", True), (None, False)]
    monkeypatch.setattr(R, "first_object", seen_nothing)
    got = [(r.winner, r.error is None) for r in R.parse_replies(df, "pair").orderBy("i").collect()]
    # what follows a whole object does not matter, so the fifth one is read as well
    assert got == [("A", True), ("B", True), (None, False), (None, False), ("A", True), (None, False)]
