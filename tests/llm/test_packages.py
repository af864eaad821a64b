from __future__ import annotations

import glob
import io
import random
import zipfile

import pytest

from pickline.llm import packages as P

SCHEMA = "page_id long, url string, html string, refers_to string, digest int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], SCHEMA)


def expected(rows):
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        first = min(same) if same else None
        revisit = first is not None and i != first
        out.append((i, len(body), P.base32_sha1(body), "revisit" if revisit else "response",
                    first if revisit else None))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                   for r in df.collect()), key=repr)


@pytest.mark.parametrize("access", ["ranges", "content"])
@pytest.mark.parametrize("zip64", [False, True])
def test_round_trip(spark, tmp_path, access, zip64):
    rng = random.Random(5)
    rows = [(i, f"http://h/{i} a\r\nX: y", rng.choice(["", None, "<p>é\r\n\r\n</p>", "x" * 200_000, f"own {i}"]))
            for i in range(60)]
    rows += [(None, None, "own 3"), (None, "u", "alone"), (7, None, rows[7][2])]
    given = P.with_revisits(pages(spark, rows).select("page_id", "url", "html")).repartition(3)
    path = str(tmp_path / "packages")
    P.write_packages(given, path, member_bytes=2000, zip64=zip64)
    got = P.read_packages(spark, path, payloads=True, access=access)
    assert found(got) == expected(rows)
    texts = {i: (h or "").encode() for i, _, h in rows if i is not None}
    assert all(bytes(r.payload) == texts[r.page_id] for r in got.collect()
               if r.record_type == "response" and r.page_id is not None)
    parts = [f for f in glob.glob(path + "/part*") if open(f, "rb").read(1)]
    assert parts
    for f in parts:  # another reader opens them too
        with zipfile.ZipFile(f) as z:
            assert z.testzip() is None
            assert all(x.compress_type == zipfile.ZIP_STORED for x in z.infolist())


def test_empty_and_min_bytes(spark, tmp_path):
    assert P.with_revisits(pages(spark, []).select("page_id", "url", "html")).collect() == []
    P.write_packages(P.with_revisits(pages(spark, []).select("page_id", "url", "html")), str(tmp_path / "e"))
    assert P.read_packages(spark, str(tmp_path / "e")).collect() == []
    small = P.with_revisits(pages(spark, [(1, "u", "ab"), (2, "u", "ab")]).select("page_id", "url", "html"), 3)
    assert [r.refers_to for r in small.collect()] == [None, None]


def test_packages_of_other_writers_and_damage():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\x05\x06 not the end"
        z.writestr("archive/a.warc.gz", b"abc")
    raw = data.getvalue()
    (name, header, size, _), = P.read_directory(io.BytesIO(raw), len(raw))
    start = P.member_start(io.BytesIO(raw), header)
    assert (name, raw[start : start + size]) == ("archive/a.warc.gz", b"abc")
    with pytest.raises(ValueError):
        P.read_directory(io.BytesIO(b"x" * 100), 100)
    record = P.pack_record(1, "u", b"payload", None)
    assert P.parse_record(record)["payload"] == b"payload"
