from __future__ import annotations

import hashlib
from collections import defaultdict

from pickline.llm.exact import drop_copies, exact_groups

SCHEMA = "doc_id long, text string, keep_id string, kept string, _row int"


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=repr)


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)


def test_groups_ties_nulls_and_clashing_columns(spark):
    rows = [(1, "a"), (5, "a"), (5, "a"), (3, None), (4, ""), (None, "a"), (None, "n"), (None, "n"),
            (9, "a "), (10, "x" * 300_000), (11, "x" * 300_000)]
    got = exact_groups(rows_of(spark, rows)).cache()
    assert found(got) == expected(rows)
    kept = [(r.text_sha256, r.doc_id) for r in got.filter("kept").collect()]
    assert len(kept) == len({t or "" for _, t in rows}) == len({k for k, _ in kept})
    assert all(r.doc_id == r.keep_id for r in got.filter("kept").collect())


def test_light_path_agrees_with_heavy_path(spark):
    rows = [(i, f"t{i % 7 if i % 3 else 0}") for i in range(300)]
    for heavy in (1, 4096):
        assert found(exact_groups(rows_of(spark, rows), heavy=heavy, tracked=16 if heavy == 1 else 8192)) == expected(rows)


def test_empty_table_and_dropping(spark):
    assert exact_groups(rows_of(spark, [])).collect() == []
    rows = [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (None, "b")]
    kept = drop_copies(rows_of(spark, rows))
    assert kept.columns == ["doc_id", "text", "keep_id", "kept", "_row"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == [(2, "a"), (4, ""), (None, "b")]
