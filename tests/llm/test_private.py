from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pickline.llm import private

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda x: (x[1], private.KINDS.index(x[0])))


@given(st.one_of(
    st.text(alphabet="a.@-_+ 01259()é", max_size=40),
    st.lists(st.sampled_from(["a@b.co", "1.2.3.4", "4111 1111 1111 1111", "+1 (743) 555-3824", ".", "@", "5", " ", "x",
                              "at", "dot", "256.1.1.1", "one", "two", "plus", "(at)", "а", "＠"]), max_size=14).map("".join)))
@settings(max_examples=600, deadline=None)
def test_base_spans_are_the_patterns_own(text):
    base, every = private.find_all(text)
    assert base == brute(text)
    assert [x for x in every if x in base] == base
    assert all(0 <= s < e <= len(text) for _, s, e in every)


@pytest.mark.parametrize("text,kind,found", [
    ("write to jane.doe (at) mail (dot) example (dot) org now", "email", "jane.doe (at) mail (dot) example (dot) org"),
    ("write jane at example dot com, please", "email", "jane at example dot com"),
    ("jane[at]example.com!", "email", "jane[at]example.com"),
    ("see jаne＠exаmple.com ok", "email", "jаne＠exаmple.com"),
    ("call plus four nine three zero one two three four five six seven today", "phone",
     "plus four nine three zero one two three four five six seven"),
    ("card four one one one one one one one one one one one one one one one end", "card",
     "four one one one one one one one one one one one one one one one"),
    ("host one nine two dot one six eight dot one dot seven up", "ip", "one nine two dot one six eight dot one dot seven"),
    ("ｃａｌｌ ＋４９ ３０ １２３４５６７８９ x", "phone", "＋４９ ３０ １２３４５６７８９"),
    ("ja​ne@ex​ample.com x", "email", "ja​ne@ex​ample.com"),
])
def test_disguises(text, kind, found):
    base, every = private.find_all(text)
    start = text.index(found)
    assert (kind, start, start + len(found)) in every


@pytest.mark.parametrize("text", [
    "meet me at example.com or at noon", "one, two, three and we go", "un deux trois soleil", "look at the dot on it",
    "Слово за слово", "a​b", "версия 1.2.3", "at at at dot dot dot"])
def test_clean_texts_stay_clean(text):
    assert private.find_all(text)[1] == []


@pytest.mark.parametrize("text,kind,part", [
    ("jоhn@x.com", "email", "hn@x.com"), ("john@mail.exаmple.com", "email", "john@mail.ex"),
    ("john@mail.example (dot) com", "email", None), ("192.168.1.1２", "ip", "192.168.1.1"),
    ("+49 30 1234567８９", "phone", "+49 30 1234567")])
def test_disguises_that_the_base_pattern_finds_a_part_of(spark, text, kind, part):
    base, every = private.find_all(f"see {text}, ok")
    assert (kind, 4, 4 + len(text)) in every and all(x in every for x in base)
    assert part is None or [f"see {text}, ok"[s:e] for _, s, e in base if _ == kind] in ([part], [])
    docs = spark.createDataFrame([(1, f"see {text}, ok")], "doc_id long, text string")
    assert private.redacted(docs).first().text == f"see <{kind.upper()}>, ok"


def test_long_runs_take_linear_time():
    text = "a" * 300_000 + "@" + "1" * 300_000 + " " * 300_000 + "one " * 50_000 + "(" * 200_000
    private.find_all(text)


def test_rows(spark):
    rows = [(1, "a@b.co и 1.2.3.4"), (2, None), (3, ""), (None, "+1 (743) 555-3824"), (1, "a@b.co и 1.2.3.4"),
            (4, "x" * 200_000 + " jane (at) example (dot) org")]
    docs = spark.createDataFrame([(i, t, "s", 1, "b") for i, t in rows], "doc_id long, text string, spans string, n_ip int, base string")
    got = private.personal_data(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert (by[1].n_email, by[1].n_ip, by[1].spans) == (1, 1, "email:0:6,ip:9:16")
    assert by[2].spans == by[3].spans == "" and by[None].n_phone == 1
    assert by[4].n_email == 0 and by[4].spans == f"email:200001:{200001 + 27}"
    out = {r.doc_id: r for r in private.redacted(docs).collect()}
    assert out[1].text == "<EMAIL> и <IP>" and out[2].text is None and out[4].text.endswith(" <EMAIL>")
    assert private.personal_data(docs.limit(0)).collect() == []
