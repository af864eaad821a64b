from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pickline.llm import prints

SCHEMA = "doc_id long, text string, id string, none int, th string, keys int, head string"


def paragraphs(text):
    found = re.findall(r"[^\n]{100,}?[.!?]+|[^\n]+", text or "")
    return {p.strip(" \t\r") for p in found} - {""}


def alike(one, two):
    a, b = paragraphs(one), paragraphs(two)
    return len(a & b) / len(a | b) if a | b else 1.0


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, "z") for i, t in rows], SCHEMA).repartition(3)


def words(rng, n):
    return " ".join(rng.choice("lorem ipsum dolor sit amet consetetur".split()) + str(rng.randrange(999)) for _ in range(n))


def texts(rng, n):
    pool = [words(rng, rng.choice([3, 8, 20])) + "." for _ in range(80)]
    return ["\n".join(rng.choices(pool, k=rng.choice([0, 1, 2, 5, 12, 30]))) for _ in range(n)]


def test_as_brute_force(spark):
    rng = random.Random(4)
    rows = list(zip(rng.sample(range(10_000), 70), texts(rng, 70), strict=True))
    rows += [(20_000, None), (20_001, ""), (None, "tail\ntext one. two"), (-5, "😀ñ" * 30), (20_003, " \n\t\n"),
             (20_004, " ".join(words(rng, 9) + rng.choice(".!?") for _ in range(400)))]
    rows += [rows[3], rows[3], (20_002, rows[4][1])]
    got = prints.edited_fingerprints(frame(spark, rows)).collect()
    assert got[0].__fields__ == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                                 "near_edited", "near_next"]
    order = sorted({i for i, _ in rows}, key=lambda i: (i is None, -(i or 0)))
    by_id = dict(rows)
    want = []
    for i, t in rows:
        t = t or ""
        after = by_id[order[(order.index(i) + 1) % len(order)]] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(alike(t, edited), 9), round(alike(t, after), 9)))
    assert sorted(want, key=repr) == sorted(
        [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got], key=repr)
    seen = {}
    for r in got:
        seen.setdefault(by_id[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(s) == 1 for s in seen.values())
    assert len({next(iter(seen[t])) for t in seen}) == len({frozenset(paragraphs(t)) for t in seen})


def test_several_texts_of_one_id_and_single_ids(spark):
    got = prints.edited_fingerprints(frame(spark, [(1, "ab"), (1, "cd"), (1, "cd")])).collect()
    assert len(got) == 3 and {r.near_edited for r in got} <= {0.0, 1.0}
    one = prints.edited_fingerprints(frame(spark, [(None, "ab\ncd")])).first()
    assert (one.doc_id, one.n_chars, one.near_next) == (None, 5, 1.0)
    assert prints.edited_fingerprints(frame(spark, []).limit(0)).collect() == []


@pytest.mark.parametrize("cells", [prints.PART_CELLS, (1,), ()])
def test_versions_recover_their_paragraphs(spark, monkeypatch, cells):
    monkeypatch.setattr(prints, "PART_CELLS", cells)
    rng = random.Random(9)
    pairs = [(a, "\n".join(rng.sample(a.split("\n"), k=len(a.split("\n")) // 2) + ["new one", "new two"]))
             for a in texts(rng, 20)] + [(None, "a\nb"), ("a\n" * 900, "a"), ("", None)]
    pairs += [("\n".join(f"p{i}" for i in range(3000)), "\n".join(f"p{i}" for i in range(2990, 5000)))]
    table = spark.createDataFrame(pairs, "one string, two string")
    digest = F.transform(F.split("s", "\n"), lambda p: F.xxhash64(F.btrim(p, F.lit(" \t\r"))))
    for r in prints.compared(table, "one", "two").collect():
        only = [paragraphs(r.one) - paragraphs(r.two), paragraphs(r.two) - paragraphs(r.one)]
        named = [spark.createDataFrame([("\n".join(sorted(s)),)], "s string").select(digest.alias("d")).first().d
                 if s else [] for s in only]
        assert [set(r.removed), set(r.added)] == [set(n) for n in named]
        assert len(r.removed) == len(only[0]) and len(r.added) == len(only[1])
        assert r.likeness == pytest.approx(alike(r.one, r.two))


def test_no_python_worker_in_the_plan(spark):
    plan = prints.edited_fingerprints(frame(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_larger_sketches_succeed_where_smaller_fail(spark):
    rng = random.Random(2)
    rows = [([rng.getrandbits(63) for _ in range(n)], [rng.getrandbits(63) for _ in range(n)]) for n in [0, 1, 3, 6, 12] * 40]
    table = spark.createDataFrame(rows, "a array<long>, b array<long>")
    rates = table.select(*[prints._try(F.col("a"), F.col("b"), width, level).isNotNull().cast("int").alias(f"t{level}")
                           for level, width in enumerate(prints.PART_CELLS, 1)]).agg(
        *[F.avg(f"t{level}") for level in range(1, len(prints.PART_CELLS) + 1)]).first()
    assert 0.4 < rates[0] < rates[1] <= rates[2] == 1.0
