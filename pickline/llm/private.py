"""Personal data in whole texts, also where it is disguised, with spans in the source.

Base spans are what the plain patterns match. Then three transducers rewrite disguises, one after
the other: look-alike and compatibility characters to ASCII, at/dot disguises to their marks, and
spelled digits to digits. Each keeps which source characters a rewritten stretch came from, so a
match in the normalised text is mapped back to source characters. Matches that touch a rewritten
stretch are added to the base spans, which always stay, unless one of their kind contains them.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickline.llm.common import narrowed, table, whole_text

KINDS = ("email", "ip", "card", "phone")

# The base patterns of the task.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters that look like ASCII letters.
_ALIKE = {
    "а": "a", "в": "b", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "З": "3", "І": "I", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".",
    "。": ".", "·": ".", " ": " ", "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "",
    "­": "",
}
# Last labels that a wholly spelled address may have.
_LAST = frozenset("com org net edu gov mil int info biz io ai app dev co uk de fr es it nl eu us ca ch at be pl "
                  "ru cn jp br in au mx ar cl example test invalid".split())
# Digits by name in English, German, French and Spanish.
_NAMES = (
    ("zero", "oh", "null", "zéro", "cero"), ("one", "eins", "un", "uno"), ("two", "zwei", "deux", "dos"),
    ("three", "drei", "trois", "tres"), ("four", "vier", "quatre", "cuatro"), ("five", "fünf", "cinq", "cinco"),
    ("six", "sechs", "seis"), ("seven", "sieben", "sept", "siete"), ("eight", "acht", "huit", "ocho"),
    ("nine", "neun", "neuf", "nueve"),
)
_DIGITS = {name: str(d) for d, names in enumerate(_NAMES) for name in names}

_NAME = "(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + ")"
_SEP = r"(?:[ \t,-]{1,2}|[ \t]{0,2}\.[ \t]{0,2}|[ \t]{1,2}(?:dot|punkt|point|punto)[ \t]{1,2})"
_SPELLED = re.compile(
    rf"(?i)(?:\b(?:plus)[ \t]{{1,2}})?\b(?:{_NAME}|[0-9]{{1,19}}){_SEP}(?:{_NAME}|[0-9]{{1,19}})(?:{_SEP}(?:{_NAME}|[0-9]{{1,19}}))+\b")
_SPELLED_PART = re.compile(rf"(?i)plus|{_NAME}|[0-9]+|dot|punkt|point|punto|\.")
_ANY_NAME = re.compile(rf"(?i)\b{_NAME}[ \t,.-]{{1,4}}(?:(?:dot|punkt|point|punto)[ \t]{{1,2}})?(?:{_NAME}|[0-9]+)\b")

# Digits that are articles too, and what they must look like to be digits.
_ARTICLES = frozenset(("un", "uno"))
_ARTICLE_RUN = re.compile(r"\buno?[ \t,.-]{1,4}(?:(?:dot|punkt|point|punto)[ \t]{1,2})?(?:uno?|[0-9]+)\b")

_AT = re.compile(r"(?i)\s{0,3}[(\[{<]\s{0,3}(?:at|@|arroba)\s{0,3}[)\]}>]\s{0,3}|\s{1,3}(?:at|arroba)\s{1,3}|\s{1,3}@\s{0,3}|@\s{1,3}|@")
_BRACKET_AT = re.compile(r"[(\[{<]\s{0,3}(?:at|arroba)")
_BRACKET_DOT = r"\s{0,3}[(\[{<]\s{0,3}(?:dot|punkt|point|punto|\.)\s{0,3}[)\]}>]\s{0,3}"
_DOT = re.compile(rf"(?i){_BRACKET_DOT}|\s{{1,3}}(?:dot|punkt|point|punto)\s{{1,3}}|\.")
_SPELLED_DOT = re.compile(rf"(?i){_BRACKET_DOT}|\s{{1,3}}(?:dot|punkt|point|punto)\s{{1,3}}")
_LABEL = re.compile(r"[A-Za-z0-9-]+")


#: Where such characters can be: the few of Latin-1, and all beyond.
_BEYOND = re.compile("[\xa0\xad\xb7\u0100-\U0010ffff]")


@lru_cache(maxsize=1)
def _alike() -> dict[str, str]:
    """Characters to rewrite: the list above, and all whose compatibility form is one ASCII character."""
    table = dict(_ALIKE)
    for point in range(0x250, 0x20000):
        c = chr(point)
        plain = unicodedata.normalize("NFKC", c)
        if c not in table and len(plain) == 1 and plain != c and " " <= plain < "\x7f":
            table[c] = plain
        elif c not in table and unicodedata.category(c) == "Nd":
            table[c] = str(unicodedata.digit(c))
    return table


# ---- detection ----------------------------------------------------------------------------------

def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def detect(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind's pattern, less those that fail its check.

    Matching takes time in proportion to the text: an address is read from its @ to both sides, and
    an IP from a maximal dotted run of digits, which gives the pattern's own matches.
    """
    found, before = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > before and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            found.append(("email", start, m.end()))
            before = m.end()
        at = text.find("@", at + 1)
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            parts, at = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = at + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                    found.append(("ip", at, end))
                at = end + 1
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


# ---- transducers --------------------------------------------------------------------------------

class Rewritten:
    """A text with some stretches replaced, and the way back."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, at, shift = [], 0, 0
        self.starts, self.ends, self.froms, self.tos = [], [], [], []
        for start, end, new in edits:
            parts += [text[at:start], new]
            self.starts.append(start + shift)
            self.ends.append(start + shift + len(new))
            self.froms.append(start)
            self.tos.append(end)
            shift += len(new) - (end - start)
            at = end
        parts.append(text[at:])
        self.text = "".join(parts)

    def touches(self, start: int, end: int) -> bool:
        """Whether ``[start, end)`` has rewritten characters, or drops some inside."""
        i = bisect_right(self.ends, start)
        return i < len(self.starts) and self.starts[i] < end or any(
            start < self.starts[k] < end for k in range(bisect_left(self.starts, start), bisect_left(self.starts, end)))

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source stretch of ``[start, end)``, whole where it cuts a rewritten one."""
        return self._back(start, False), self._back(end - 1, True) + 1

    def _back(self, at: int, last: bool) -> int:
        i = bisect_right(self.starts, at) - 1
        while i >= 0 and self.starts[i] == self.ends[i]:  # a dropped stretch has no characters
            if not last or i == 0:
                break
            if self.starts[i] <= at:
                break
            i -= 1
        if i < 0:
            return at
        if at < self.ends[i]:
            return self.tos[i] - 1 if last else self.froms[i]
        return at - self.ends[i] + self.tos[i]


def _letters(text: str) -> list[tuple[int, int, str]]:
    plain = _alike()
    return [(m.start(), m.end(), plain[m[0]]) for m in _BEYOND.finditer(text) if m[0] in plain]


def _marks(text: str) -> list[tuple[int, int, str]]:
    """At/dot disguises inside whole addresses; a bare ``at`` needs a spelled dot and a known last label."""
    low = text.lower()
    if not ("@" in text or _BRACKET_AT.search(low)
            or (" at" in low or "arroba" in low) and any(w in low for w in ("dot", "punkt", "point", "punto"))):
        return []
    edits, done = [], 0
    for at in _AT.finditer(text):
        if at.start() < max(done, 1) or text[at.start() - 1] not in _LOCAL:
            continue
        own, place, spelled = [(at.start(), at.end(), "@")], at.end(), False
        label = _LABEL.match(text, place)
        while label and (dot := _DOT.match(text, label.end())) and (more := _LABEL.match(text, dot.end())):
            spelled |= bool(_SPELLED_DOT.fullmatch(dot[0]))
            own.append((dot.start(), dot.end(), "."))
            label = more
        bare = at[0].strip().lower() in ("at", "arroba")
        spaced = at[0].strip() == "@" and len(at[0]) > 1
        known = label and label[0].lower() in _LAST
        if len(own) > 1 and label and (spelled and known or not bare and not spaced):
            edits += [e for e in own if text[e[0] : e[1]] != e[2]]
            done = label.end()
    return edits


def _digits(text: str) -> list[tuple[int, int, str]]:
    low = text.lower()
    there = _DIGITS.keys() & set(low.replace(",", " ").replace("-", " ").replace(".", " ").split())
    if not there or there <= _ARTICLES and not _ARTICLE_RUN.search(low) or not _ANY_NAME.search(text):
        return []
    edits = []
    for m in _SPELLED.finditer(text):
        new = ""
        for p in _SPELLED_PART.finditer(m[0]):
            word = p[0].lower()
            new += _DIGITS.get(word) or ("+" if word == "plus" else p[0] if word.isdigit() else ".")
        if any(n.lower() in _DIGITS for n in re.findall(r"[^\W\d_]+", m[0])):
            edits.append((m.start(), m.end(), new))
    return edits


def find_all(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: the base ones and those found behind disguises."""
    base, layers, now = detect(text), [], text
    for transducer in (_letters, _marks, _digits):
        edits = transducer(now)
        if edits:
            layers.append(Rewritten(now, edits))
            now = layers[-1].text
    if not layers:
        return base, base
    added = set()
    for kind, start, end in detect(now):
        touched = False
        for layer in reversed(layers):
            touched |= layer.touches(start, end)
            start, end = layer.source(start, end)
        if touched and not any(k == kind and s <= start and end <= e for k, s, e in base):
            added.add((kind, start, end))
    return base, sorted([*base, *added], key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


# ---- Spark --------------------------------------------------------------------------------------

def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, n_email, n_ip, n_card, n_phone, base, spans)``.

    The counts are those of the base spans. ``base`` and ``spans`` are ``kind:start:end`` by start,
    then kind, comma-joined, in code points with the end exclusive. A null text is the empty text,
    which has no spans; null ids and repeated rows are read like any row; an empty table gives no
    rows. Other columns are not read.
    """

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text in batch["text"].to_pylist():
                base, every = find_all(text)
                counts = [sum(x[0] == k for x in base) for k in KINDS]
                rows.append((*counts, _joined(base), _joined(every)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base", "spans"])

    return narrowed(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long"), whole_text("text").alias("text")).mapInArrow(
        read, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``<KIND>``; other columns as they came.

    Overlapping spans are replaced as one, by the kind of the first.
    """

    @F.pandas_udf("string")
    def redact(texts):
        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for kind, start, end in find_all(text)[1]:
                if start >= at:
                    out += [text[at:start], f"<{kind.upper()}>"]
                at = max(at, end)
            return "".join(out) + text[at:]

        return texts.map(one)

    return docs.withColumn(text_col, redact(F.col(f"`{text_col}`").cast("string")))


def op8_personal_data(spark, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return personal_data(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
