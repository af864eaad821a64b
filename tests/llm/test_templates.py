from __future__ import annotations

import random
import re
from collections import defaultdict

import pyarrow as pa

from pickline.llm import templates

SCHEMA = "doc_id long, text string, th string, dropped int, _row int"


def keys_of(line):
    """The templates of a line as readable tuples."""
    t = tuple("<*>" if re.search("[0-9]", x) else x for x in re.findall(r"[^\x20\x09-\x0D]+", line))
    n = len(t)
    found = [(0, t)] if n else []
    if n >= 8:
        for j in range(4):
            low, high = 3 + j * (n - 3) // 4, 3 + (j + 1) * (n - 3) // 4
            found.append((j + 1, t[:low] + ("<*>",) * (high - low) + t[high:]))
    return found


def brute(rows, least=10):
    """Lines dropped per row; sketches are the operator's own hashes, grouped here by hand."""
    seen = defaultdict(list)
    for _, text in rows:
        _, number, n, found = templates.line_templates(pa.array([text or ""]))
        own = {}
        for line, key in zip((text or "").split("\n"), found[:, 0].tolist(), strict=True):
            if keys_of(line):
                own.setdefault(key, line)
        for key, line in own.items():
            others = [k for k in own if k != key]
            for t in keys_of(line):
                seen[t].append(min(others, default=0))
    gone = {t for t, s in seen.items() if len(set(s)) >= least and 2 * len(set(s)) >= len(s)}
    return [[k for k, line in enumerate((text or "").split("\n")) if any(t in gone for t in keys_of(line))]
            for _, text in rows]


def corpus():
    rng = random.Random(2)
    vocab = [f"{a}{b}" for a in "abcdefgh" for b in "uvwxyz"]
    prose = lambda: " ".join(rng.choices(vocab, k=rng.choice([3, 9, 20, 40])))
    rows = []
    for i in range(150):
        lines = [prose() for _ in range(rng.choice([1, 2, 5]))]
        if rng.random() < 0.5:
            lines.insert(rng.randrange(len(lines) + 1), f"Page {rng.randrange(99)} of {rng.randrange(99)}")
        if rng.random() < 0.4:
            lines.append(f"Posted by the user {rng.choice(vocab)}{rng.choice(vocab)} on our forum about cooking")
        if rng.random() < 0.3:
            lines.append("All rights reserved.")
        rows.append((i, "\n".join(lines)))
    copied = "\n".join(prose() for _ in range(6))
    rows += [(1000 + i, copied) for i in range(60)]
    return rows


def test_as_brute_force(spark):
    rows = corpus()
    rows += [(2000, None), (2001, ""), (2002, "\n\n"), (None, "Page 1 of 2\nown words here"), (3, rows[3][1]),
             (2003, "long " * 60_000 + "\nPage 3 of 4"), (2004, "Page 7 of 7")]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA).repartition(3)
    want = sorted(((i, d) for (i, _), d in zip(rows, brute(rows), strict=True)), key=repr)
    got = templates.drop_template_lines(docs, report=True).collect()
    assert sorted(((r.doc_id, list(r.dropped)) for r in got), key=repr) == want
    assert any(d for _, d in want) and not any(d for i, d in want if i is not None and 1000 <= i < 1060)
    kept = templates.drop_template_lines(docs)
    assert kept.columns == docs.columns
    texts = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert texts == sorted(((i, None if t is None else "\n".join(
        x for k, x in enumerate(t.split("\n")) if k not in d)) for (i, t), d in zip(rows, brute(rows), strict=True)), key=repr)


FOOTER = "All rights of the makers are reserved."


def words(*seed):
    rng = random.Random(repr(seed))
    return " ".join("".join(rng.choices("abcdefghijkl", k=7)) for _ in range(12))


def dropped(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    return {r.doc_id: list(r.dropped) for r in templates.drop_template_lines(docs, report=True).collect()}


def test_copies_of_one_page_keep_no_footer(spark):
    page = "\n".join([*(words("page", k) for k in range(5)), FOOTER])
    got = dropped(spark, [words("own", i) + "\n" + FOOTER for i in range(30)] + [page] * 300)
    assert got == {i: [1] if i < 30 else [5] for i in range(330)}


def test_lines_that_documents_share_are_no_identity(spark):
    texts, want = [], []
    for kind, (shared, own) in enumerate([(2, 1), (3, 1), (4, 2), (6, 8)]):
        lines = [words("shared", kind, k) for k in range(shared)]
        for i in range(40):
            texts.append("\n".join(lines + [words("own", kind, i, k) for k in range(own)]))
            want.append([*range(shared)])
    assert dropped(spark, texts) == dict(enumerate(want))


def test_templates_share_one_stretch():
    same = ["the user a b c d e wrote this text here", "the user a b c d e wrote that text here"]
    _, _, _, found = templates.line_templates(pa.array(same))
    assert len(set(found[0].tolist()) & set(found[1].tolist())) == 1
    two = ["page 1 of 2", "page 31 of 7", "page x of 2"]
    _, _, n, found = templates.line_templates(pa.array(two))
    assert found[0, 0] == found[1, 0] != found[2, 0] and n.tolist() == [4, 4, 4]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert templates.drop_template_lines(docs).collect() == []
