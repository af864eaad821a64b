from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pickline.llm import fill

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, part string, rank int, sequence_id string"


WHOLE = Tokenizer.from_file(PATH)


def direct(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 0]


def checked(spark, rows, size):
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(3)
    packed = fill.pack_documents(docs, PATH, size, with_ids=True).cache()
    got = packed.collect()
    by = defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) <= size
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4"))
        by[r.sequence_id].append((r.offset, r.length, r.ids))
    for placed in by.values():  # gapless from 0 and within the size
        at = 0
        for offset, length, _ in sorted(placed):
            assert offset == at
            at += length
        assert at <= size
    whole = Counter()
    texts = defaultdict(list)
    for r in got:
        texts[r.doc_id].append((r.start, r.piece, r.ids))
    for i, t in rows:
        whole[i, tuple(direct(t))] += 1
    if len({i for i, _ in rows}) == len(rows):
        for i, parts in texts.items():
            parts.sort()
            assert [p for _, p, _ in parts] == list(range(len(parts)))
            assert [s for s, _, _ in parts] == [size * k for k in range(len(parts))]
            assert whole[i, tuple(x for _, _, ids in parts for x in ids)] == 1
    assert sum(r.length for r in got) == sum(len(k[1]) * n for k, n in whole.items())
    flat = {r.sequence_id: r.ids for r in fill.sequences(packed).collect()}
    assert flat == {k: [x for _, _, ids in sorted(v) for x in ids] for k, v in by.items()}
    return len(by)


def test_pack_documents(spark):
    rng = random.Random(1)
    words = "the of and thing Éleên über don't x1 2024 ... ñandú".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 20, 90])))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "a\tb\n c  d"), (903, "word " * 3000), (None, "nameless")]
    n = checked(spark, rows, 64)
    tokens = sum(len(direct(t)) for _, t in rows)
    assert n <= 1.03 * tokens / 64 + 1
    checked(spark, [(1, "same text")] * 5 + [(1, "other")], 8)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert fill.pack_documents(docs, PATH).collect() == []


@given(st.lists(st.one_of(
    st.text(alphabet=st.characters(codec="utf-8"), max_size=30),
    st.text(alphabet="aZéÉßµªÿøĀıİ.,;'s1 ", max_size=12)), max_size=8))
@settings(max_examples=300, deadline=None)
def test_chunks_give_the_ids_of_whole_texts(texts):
    own = fill._tokenizer(PATH)
    ids, ends = own.encode(pa.array(texts, pa.string()))
    begin = 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        assert ids[begin:end].tolist() == direct(text)[:-1]
        begin = end


@pytest.mark.parametrize("text", ["é b é", "ΑΣ ΑΣΑ", "<|endoftext|> a<|startoftext|>b", "a\u0085b​c\x1fd", "́ ́x", "it's I'LL 's"])
def test_chunks_at_odd_characters(text):
    assert fill._tokenizer(PATH).encode(pa.array([text]))[0].tolist() == direct(text)[:-1]


def test_forgetting_keeps_ids_right(monkeypatch):
    monkeypatch.setattr(fill, "CACHED", 5)
    own = fill.ChunkTokenizer(PATH)
    for text in ("a b c", "d e a", "b c d e f g h i", "a"):
        assert own.encode(pa.array([text]))[0].tolist() == direct(text)[:-1]


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20))
@settings(max_examples=200, deadline=None)
def test_plan_uses_every_piece_and_is_no_worse_than_first_fit(counts):
    patterns = fill.plan(counts, 50)
    used = Counter()
    for n, times in patterns:
        assert n > 0 and sum(x * k for x, k in times) <= 50
        for x, k in times:
            used[x] += n * k
    assert used == Counter(counts)
    bins = []
    for x in sorted(Counter(counts).elements(), reverse=True):  # first fit, longest first
        at = next((i for i, b in enumerate(bins) if b + x <= 50), None)
        if at is None:
            bins.append(x)
        else:
            bins[at] += x
    assert sum(n for n, _ in patterns) <= 1.1 * len(bins) + 1


def test_exact_complements():
    free = np.zeros(101, int)
    free[[10, 20, 40]] = 1, 1, 1
    assert fill.complement(free, 40) == (40,)
    assert fill.complement(free, 60) == (40, 20)
    assert fill.complement(free, 70) == (40, 20, 10)
    assert fill.complement(free, 80) is None
    assert fill.plan({40: 3, 60: 2, 100: 1}, 100) == [(1, [(100, 1)]), (2, [(60, 1), (40, 1)]), (1, [(40, 1)])]
