from __future__ import annotations

import random
import re

import pytest

from pickline.llm import repeats

SCHEMA = "doc_id long, text string, th string, start int, keep_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(3)


def expected(rows, least):
    """By a loop over all places in order of rank."""
    found = {}
    for i, t in dict.fromkeys(rows):
        for s, e, d in repeats.stretches_of(t or "", least):
            found.setdefault(d, []).append((i is None, i, s, e))
    want = set()
    for d, places in found.items():
        first, *rest = sorted(places, key=lambda p: (p[0], p[1] or 0, p[2]))
        want |= {(i, s, e, f"{d % (1 << 64):016x}", first[1], first[2]) for _, i, s, e in rest}
    return want


@pytest.mark.parametrize("heavy", [1, 4096])
def test_as_brute_force(spark, heavy):
    rng = random.Random(1)
    lines = [" ".join(rng.choices("Ab cd, ef gh. ñ".split(), k=rng.choice([2, 5, 30]))) for _ in range(25)]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.choice([0, 1, 4, 9])))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, lines[0] + "\n" + lines[3].upper()), (102, " \t".join(lines[3].split())),
             (7, rows[7][1]), (103, "long " * 50_000), (104, "a b. " * 9_000), (105, " \n\t"), (106, rows[9][1] + " .")]
    docs = frame(spark, rows)
    got = repeats.repeated_units(docs, least_words=8, heavy=heavy, tracked=max(64, heavy))
    want = expected(rows, 8)
    assert {tuple(r)[:6] for r in got.collect()} == want and got.count() == len(want) > 100
    kept = repeats.without_repeats(docs, least_words=8, heavy=heavy, tracked=max(64, heavy))
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert {r.text for r in kept.filter("doc_id = 100").collect()} == {None}
    assert sum(len(r.text or "") for r in kept.collect()) < 0.9 * sum(len(t or "") for _, t in rows)
    assert repeats.repeated_units(docs.limit(0)).collect() == []


def passage(rng, n):
    words = [f"w{rng.randrange(10_000)}" + rng.choice(["", "", "", ",", "."]) for _ in range(n)]
    return " ".join(words)


@pytest.mark.parametrize("how", ["six lines", "wrapped elsewhere", "within other words", "one line"])
def test_passages_of_sixty_words(spark, how):
    rng = random.Random(how)
    rows, planted = [], []
    for i in range(40):
        words = passage(rng, 60).split(" ")
        again = list(words)
        own, other = (" ".join(passage(rng, 30) for _ in range(2)) for _ in range(2))
        if how == "six lines":
            one = two = "\n".join(" ".join(words[k : k + 10]) for k in range(0, 60, 10))
            rows += [(2 * i, own + "\n" + one + "\n" + own[::-1]), (2 * i + 1, other + "\n" + two)]
        elif how == "one line":
            rows += [(2 * i, own + "\n" + " ".join(words)), (2 * i + 1, " ".join(words).upper() + "\n" + other)]
        else:
            for at in range(7, 60, 13):
                again[at] += "\n"
            joint = " " if how == "within other words" else ".\n"
            rows += [(2 * i, own + joint + " ".join(words) + " " + own[::-1]),
                     (2 * i + 1, other + joint + " ".join(again) + " " + other[::-1])]
        planted.append(2 * i + 1)
    found = {r.doc_id for r in repeats.repeated_units(frame(spark, rows)).collect()}
    assert len(found & set(planted)) >= 36 and found <= set(planted)
    kept = " ".join(r.text for r in repeats.without_repeats(frame(spark, rows)).collect()).lower()
    assert {w for _, t in rows for w in re.findall(r"\w+", t.lower())} == set(re.findall(r"\w+", kept))


def test_offsets_and_stock_phrases():
    text = "  Ab cd,\nef  gh.\n\nAB CD"
    assert [(text[s:e], p, n) for s, e, p, n in repeats.units_of(text, "clause")] == [
        ("Ab cd,", "ab cd,", 2), ("ef  gh.", "ef gh.", 2), ("AB CD", "ab cd", 2)]
    assert [text[s:e] for s, e, _, _ in repeats.units_of(text, "line")] == ["Ab cd,", "ef  gh.", "AB CD"]
    assert sorted(text[s:e] for s, e, _ in repeats.stretches_of(text, 3)) == [
        "Ab cd,\nef  gh.", "ef  gh.\n\nAB CD"]
    assert repeats.stretches_of("All rights reserved. " * 2) == set()
