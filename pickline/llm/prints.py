"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame operations only.

A text is the set of its paragraphs' 64-bit digests. Each digest is added to three cells of a sketch;
a cell holds a count and the exclusive-or of its digests and of their check sums. Sketches of two
versions subtract cell by cell, so that shared paragraphs cancel, and peeling recovers the rest: a
cell with a count of 1 or -1 and a matching check sum names a differing digest, which is taken out
of its other cells, and so on. If cells are left over, the pair is tried again with larger sketches:
by the digests' hash it is split over so many small sketches that each holds a few of them.

Everything is an expression over the columns of one row. Only texts on their way to their
predecessor in the order of ids are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickline.llm.common import narrowed, table, whole_text
from pickline.operators.ordering import with_position
from pickline.session import cut

#: Paragraphs end at line feeds; a longer line also at the first sentence end after so many characters.
LONG_LINE = 100
_PARAGRAPH = rf"[^\n]{{{LONG_LINE},}}?[.!?]+|[^\n]+"
#: Cells for each of the three hashes (powers of two): of the fingerprint, and of one of the many
#: sketches of a larger try, then of this sketch alone from one failure to the next.
PRINT_CELLS, PART_CELLS = 8, (4, 16, 64)
#: Digests of both versions for each of these sketches.
LOAD = 4
#: Rounds of peeling.
ROUNDS = 8
_SALT = 0x5EED


def digests(text: Column) -> Column:
    """The distinct digests of the paragraphs that are not blank, without blanks at their ends."""
    pieces = F.transform(F.regexp_extract_all(text, F.lit(_PARAGRAPH), F.lit(0)), lambda p: F.btrim(p, F.lit(" \t\r")))
    return F.array_distinct(F.transform(F.filter(pieces, lambda p: p != ""), lambda p: F.xxhash64(p)))


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _shifted(value: Column, bits: int | Column) -> Column:
    return F.call_function("shiftrightunsigned", value, F.lit(bits) if isinstance(bits, int) else bits)


def _hashed(keys: Column, level: int) -> Column:
    """``(k, x, h)``: digest, check sum and the level's hash, which deals it to cells and sketches."""
    return F.transform(keys, lambda k: F.struct(
        k.alias("k"), F.hash(k, F.lit(_SALT)).alias("x"), F.xxhash64(k, F.lit(level)).alias("h")))


def _cell_places(width: int) -> Column:
    """Of each cell: where its hash begins in the digest's, and its number there."""
    places = ", ".join(f"named_struct('shift', {8 * i}, 'c', {c}L)" for i in range(3) for c in range(width))
    return F.expr(f"array({places})")


def _in_cell(h: Column, place: Column, width: int) -> Column:
    return _shifted(h, place["shift"]).bitwiseAND(F.lit(width - 1).cast("long")) == place["c"]


def _taken(cell: Column, n: Column, e: Column) -> Column:
    return F.struct((cell["n"] + n).alias("n"), cell["k"].bitwiseXOR(e["k"]).alias("k"),
                    cell["x"].bitwiseXOR(e["x"]).alias("x"))


def sketch(hashed: Column, width: int) -> Column:
    """The ``3 * width`` cells ``(n, k, x)`` of hashed digests."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).alias("x"))
    return F.transform(_cell_places(width), lambda place: F.aggregate(
        F.filter(hashed, lambda e: _in_cell(e["h"], place, width)), empty, lambda cell, e: _taken(cell, F.lit(1), e)))


def subtracted(one: Column, two: Column) -> Column:
    """The sketch of what differs: paragraphs of the first count 1, those of the second -1."""
    return F.zip_with(one, two, lambda a, b: _taken(a, -b["n"], b))


def peeled(cells: Column, width: int, level: int) -> Column:
    """``(ok, found)``: the differing digests ``(n, k)``, and whether nothing is left in the cells."""
    start = F.struct(cells.alias("cells"), F.array().cast("array<struct<n:int,k:bigint>>").alias("found"))

    def pure(state):
        right = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (F.hash(c["k"], F.lit(_SALT)) == c["x"]))
        return F.transform(F.array_distinct(right), lambda c: F.struct(
            c["n"].alias("n"), c["k"].alias("k"), c["x"].alias("x"), F.xxhash64(c["k"], F.lit(level)).alias("h")))

    def without(state, gone):
        left = F.zip_with(state["cells"], _cell_places(width), lambda cell, place: F.aggregate(
            F.filter(gone, lambda e: _in_cell(e["h"], place, width)), cell, lambda c, e: _taken(c, -e["n"], e)))
        named = F.transform(gone, lambda e: F.struct(e["n"].alias("n"), e["k"].alias("k")))
        return F.struct(left.alias("cells"), F.concat(state["found"], named).alias("found"))

    def round_(state, _):
        return _with(pure(state), lambda gone: F.when(F.size(gone) > 0, without(state, gone)).otherwise(state))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_)
    return _with(end, lambda s: F.struct(
        F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["x"] == 0)).alias("ok"),
        s["found"].alias("found")))


def _found(tried: Column) -> Column:
    """The digests if the try succeeded, else null."""
    return _with(tried, lambda t: F.when(t["ok"], t["found"]))


def _by_digest(one: Column, two: Column) -> Column:
    """The differing digests of two arrays, read off the arrays themselves."""

    def named(keys, n):
        return F.transform(keys, lambda k: F.struct(F.lit(n).alias("n"), k.alias("k")))

    return F.concat(named(F.array_except(one, two), 1), named(F.array_except(two, one), -1))


def _try(one: Column, two: Column, width: int, level: int) -> Column:
    """Differing digests of two arrays by sketches of one size; null if peeling leaves cells."""
    cells = subtracted(sketch(_hashed(one, level), width), sketch(_hashed(two, level), width))
    return _found(peeled(cells, width, level))


def _by_parts(one: Column, two: Column) -> Column:
    """Differing digests over many small sketches, each of them tried with more cells where it fails.

    The sketches are dealt in two steps of about equal number, so that a long text is not gone
    through once for each of them.
    """
    sides = F.greatest(F.lit(1), F.ceil(F.sqrt((F.size(one) + F.size(two)) / F.lit(float(LOAD)))).cast("int"))

    def dealt(keys, at, bits, n):
        return F.filter(keys, lambda e: F.pmod(_shifted(e["h"], bits).bitwiseAND(F.lit(0xFFFFF).cast("long")), n) == at)

    def part(a, b):
        tries = [_try(a, b, width, level) for level, width in enumerate(PART_CELLS, 1)]
        return F.coalesce(*tries, _by_digest(a, b))

    def keys(hashed):
        return F.transform(hashed, lambda e: e["k"])

    def inner(v, n):
        return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda s: _with(
            F.struct(keys(dealt(v["a"], s, 44, n)).alias("a"), keys(dealt(v["b"], s, 44, n)).alias("b")),
            lambda both: part(both["a"], both["b"]))))

    def outer(v):
        return F.flatten(F.transform(F.sequence(F.lit(0), v["n"] - 1), lambda g: _with(
            F.struct(dealt(v["a"], g, 24, v["n"]).alias("a"), dealt(v["b"], g, 24, v["n"]).alias("b")),
            lambda some: inner(some, v["n"]))))

    return _with(F.struct(_hashed(one, 0).alias("a"), _hashed(two, 0).alias("b"), sides.alias("n")), outer)


def differing(one: Column, two: Column, print_one: Column, print_two: Column) -> Column:
    """``(n, k)`` of the digests that only one of two versions has; ``n`` is 1 for the first one's.

    First from the fingerprints, then with larger sketches: as many as the digests of both call for,
    and of those that fail again each with more cells. The digests of a part that fails with the most
    cells, about one in millions, are compared one by one.
    """
    first = _found(peeled(subtracted(print_one, print_two), PRINT_CELLS, 0))
    return F.coalesce(first, _by_parts(one, two))


def likeness(one: Column, two: Column, differ: Column) -> Column:
    """Shared paragraphs by all paragraphs of both, from the number that differs; 1 if both have none."""
    sizes = F.size(one) + F.size(two)
    return F.when(sizes == 0, F.lit(1.0)).otherwise((sizes - differ) / (sizes + differ))


def printed(keys: Column, cells: Column) -> Column:
    """A fingerprint as text: the number of paragraphs, then each cell's count, digest and check sum."""
    return F.concat(F.size(keys).cast("string"), F.lit(":"), F.concat_ws(",", F.transform(
        cells, lambda c: F.concat_ws(".", c["n"].cast("string"), F.hex(c["k"]), F.hex(c["x"])))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, digests, cells, fingerprint)``, one row per row of ``docs``.

    Equal texts have equal fingerprints. A null text is the empty text, which has no paragraphs.
    """
    keyed = narrowed(docs, doc_id=id_col, text=text_col).select("doc_id", digests(whole_text("text")).alias("digests"))
    return keyed.withColumn("cells", sketch(_hashed(F.col("digests"), 0), PRINT_CELLS)).withColumn(
        "fingerprint", printed(F.col("digests"), F.col("cells")))


def compared(pairs: DataFrame, one: str, two: str) -> DataFrame:
    """``pairs`` with ``removed`` and ``added``, the digests of paragraphs that only one text has, and ``likeness``.

    ``one`` and ``two`` name the columns of the texts; the new columns replace any of these names.
    """
    first, second = digests(whole_text(f"`{one}`")), digests(whole_text(f"`{two}`"))
    keyed = pairs.withColumn("_a", first).withColumn("_b", second)
    cells = keyed.withColumn("_p", sketch(_hashed(F.col("_a"), 0), PRINT_CELLS)).withColumn(
        "_q", sketch(_hashed(F.col("_b"), 0), PRINT_CELLS))
    found = cells.withColumn("_d", differing(F.col("_a"), F.col("_b"), F.col("_p"), F.col("_q")))

    def side(n):
        return F.transform(F.filter("_d", lambda e: e["n"] == n), lambda e: e["k"])

    return found.withColumn("removed", side(1)).withColumn("added", side(-1)).withColumn(
        "likeness", likeness(F.col("_a"), F.col("_b"), F.size("_d"))).drop("_a", "_b", "_p", "_q", "_d")


# ---- edited texts -------------------------------------------------------------------------------

def _followers(docs: DataFrame) -> DataFrame:
    """For each distinct id: the next lower one, which of its texts counts, and how much of it is needed."""
    ids = docs.groupBy("none", "id").agg(
        F.min(F.xxhash64("text")).alias("th"), F.max(F.expr("length(text) div 2")).alias("need"))
    placed = cut(with_position(ids, F.col("none").asc(), F.col("id").desc(), name="at"))
    n = placed.count()
    after = placed.select(F.col("none").alias("next_none"), F.col("id").alias("next_id"), F.col("th").alias("next_th"),
                          F.pmod(F.col("at") - 1, F.lit(max(n, 1))).alias("at"))
    return cut(placed.join(after, "at").select(
        F.col("none").alias("own_none"), F.col("id").alias("own_id"), "need", "next_none", "next_id", "next_th"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited text, and how alike they are.

    ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``, one
    row per row of ``docs``. The edited text ends in the beginning of the next document's text, by
    descending id; after the least id comes the greatest. Null texts are empty texts. Rows with a
    null id come after all others, as one id. Of several rows with one id, the next document is the
    one whose text has the least hash, and the next of all of them is that of the id. A single id
    is its own next. Repeated rows give equal rows; an empty table gives none. Other columns are not
    read.
    """
    own = narrowed(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        whole_text("text").alias("text"))
    after = _followers(own)
    # the hash is compared by exclusive-or so that it doesn't become a key of the join: both joins
    # then read the same shuffle of the texts
    heads = (
        own.join(after, (own["none"] == after["next_none"]) & (own["id"] == after["next_id"]))
        .filter(F.xxhash64("text").bitwiseXOR(F.col("next_th")) == 0)
        .select("own_none", "own_id", F.left("text", "need").alias("head"), digests(F.col("text")).alias("next_keys"))
        .dropDuplicates(["own_none", "own_id"])
    )
    half = F.expr("length(text) div 2").cast("int")
    texts = own.join(heads, (own["none"] == heads["own_none"]) & (own["id"] == heads["own_id"])).select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"), F.length("text").cast("long").alias("n_chars"), "text",
        F.concat(F.left("text", F.length("text") - half), F.left("head", half)).alias("edited"), "next_keys")
    keyed = texts.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "next_keys",
                         digests(F.col("text")).alias("keys"), digests(F.col("edited")).alias("edited_keys"))
    cells = keyed.select("*", *[sketch(_hashed(F.col(k), 0), PRINT_CELLS).alias(c) for k, c in (
        ("keys", "cells"), ("edited_keys", "edited_cells"), ("next_keys", "next_cells"))])
    pairs = F.array(*[F.struct(F.col("keys").alias("a"), F.col(k).alias("b"), F.col("cells").alias("p"), F.col(c).alias("q"))
                      for k, c in (("edited_keys", "edited_cells"), ("next_keys", "next_cells"))])
    found = cells.withColumn("differ", F.transform(pairs, lambda v: F.size(differing(v["a"], v["b"], v["p"], v["q"]))))
    return found.select(
        "doc_id", "n_chars", "edited_sha256",
        printed(F.col("keys"), F.col("cells")).alias("fingerprint"),
        printed(F.col("edited_keys"), F.col("edited_cells")).alias("edited_fingerprint"),
        likeness(F.col("keys"), F.col("edited_keys"), F.col("differ")[0]).alias("near_edited"),
        likeness(F.col("keys"), F.col("next_keys"), F.col("differ")[1]).alias("near_next"))


def op13_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint next to those of its edited text and the next document."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))
