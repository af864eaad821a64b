from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pickline.llm import middles

SCHEMA = "doc_id long, text string, n string, form int, output string"


def expected(doc_id, text):
    """The contract by a plain loop over lines."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or re.search("<[PSM]>", text):
        return n, "plain", None, None, text
    low, high = sorted(x % (n + 1) for x in h[:2])
    pre, mid, suf = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < 50:
        return n, "spm", len(pre), len(mid), "<S>" + suf + "<P>" + pre + "<M>" + mid
    return n, "psm", len(pre), len(mid), "<P>" + pre + "<S>" + suf + "<M>" + mid


@given(st.integers(0, 10**6), st.text(alphabet="ab<>PSM\n\rñ😀 ", max_size=60))
def test_as_a_plain_loop_and_back(doc_id, text):
    got = middles.transform(doc_id, text)
    assert got == expected(doc_id, text)
    assert middles.restore(got[-1], got[1]) == text


def test_ends_and_wrong_units():
    assert middles.unit_ends("") == [] and middles.unit_ends("\n\na") == [1, 2, 3]
    with pytest.raises(ValueError):
        middles.unit_ends("ab", "a")


def test_shares():
    forms = [middles.transform(i, "a\nb\nc\n", changed=80, suffix_first=25)[1] for i in range(2000)]
    assert 0.15 < forms.count("plain") / 2000 < 0.25 and 0.15 < forms.count("spm") / 1600 < 0.35


def test_table(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, None), (3, ""), (None, "x\ny\n"), (4, "has <M> in it\n"),
            (5, "línea 😀\n" * 300_000), (6, "z" * 2_000_000), (7, "\n" * 1000)]
    docs = spark.createDataFrame([(i, t, "n", 1, "o") for i, t in rows], SCHEMA).repartition(3)
    got = middles.fill_in_middle(docs).collect()
    want = []
    for i, t in rows:
        *facts, output = expected(i, t)
        want.append((i, *facts, output, *(hashlib.sha256(x.encode()).hexdigest() for x in (output, t or ""))))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert middles.fill_in_middle(docs.limit(0)).collect() == []
