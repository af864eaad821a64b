"""Fill-in-the-middle examples by repeated-capture matching.

One full match of ``(unit)*`` keeps every repetition of its group. The ends of those captures give
the number of units and both cut offsets at once; texts are never walked unit by unit.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickline.llm.common import narrowed, table

SEED = 7
#: Shares in percent: documents that are changed at all, and of those the suffix-first form.
CHANGED, SUFFIX_FIRST = 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Characters of output that leave a task together.
OUT_CHARS = 4 << 20
#: A unit is a line with its line feed, or the rest of the text.
UNIT = r"[^\n]*\n|[^\n]+"

_SCHEMA = ("doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, "
           "output_sha256 string, restored_sha256 string")


def unit_ends(text: str, unit: str = UNIT) -> list[int]:
    """Where each unit ends, by one match; the repetition is possessive, so nothing is tried again.

    A unit that doesn't cover the text with its repetitions is an error.
    """
    import regex

    match = regex.fullmatch(f"({unit})*+", text)
    if match is None:
        raise ValueError("the units don't cover the text")
    return match.ends(1)


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers below 2 ** 32 for a document; a null id draws like an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def transform(doc_id: int | None, text: str, seed: int = SEED, changed: int = CHANGED,
              suffix_first: int = SUFFIX_FIRST, unit: str = UNIT) -> tuple:
    """``(n, form, prefix length, middle length, output)``; the lengths are None for a plain text."""
    ends = unit_ends(text, unit)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= changed:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text from an output and its form.

    No mark occurs in a changed text, and no mark begins inside another one or can arise across a
    border, so each mark is found where it was put.
    """
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE, 1)
    if form == "psm":
        prefix, suffix = head[len(PREFIX) :].split(SUFFIX, 1)
    else:
        suffix, prefix = head[len(SUFFIX) :].split(PREFIX, 1)
    return prefix + middle + suffix


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
                   changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST, unit: str = UNIT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n, form, prefix_chars, middle_chars, output`` and digests.

    Lengths count code points. A null text is the empty text, which is plain with ``n`` 0. A null
    id draws like an empty one. Repeated rows give equal rows. An empty table gives no rows. Other
    columns are not read. Texts are whole, whatever their length; each is handled by itself, so a
    task holds one text, its captures and its output.
    """

    def change(batches):
        import pyarrow as pa

        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                text = text or ""
                *facts, output = transform(doc_id, text, seed, changed, suffix_first, unit)
                restored = restore(output, facts[1])
                rows.append((doc_id, *facts, output, _sha(output), _sha(restored)))
                held += len(output)
                if held > OUT_CHARS:
                    yield _batch(pa, rows)
                    rows, held = [], 0
            if rows:
                yield _batch(pa, rows)

    own = narrowed(docs, doc_id=id_col, text=text_col)
    return own.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(change, _SCHEMA)


def _batch(pa, rows):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
        [f.split()[0] for f in _SCHEMA.split(", ")])


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Every document as a fill-in-the-middle example, by its digests."""
    return fill_in_middle(table(spark, sf_dir, "documents")).drop("output")


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1,
  CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a,
  greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM u),
p AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
