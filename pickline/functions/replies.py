"""Reply text to typed, checked verdicts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pickline.functions.scalars import normalize_keywords
from pickline.schemas import CATEGORIES, CONFIDENCES, PAIR_WINNERS, VERDICTS
from pickline.session import small_batches

#: Reply fields per kind, read as text first so that a wrong type is an error and not a silent null.
REPLY_FIELDS = {
    "triage": "category string, verdict string, technical_score string, reasons array<string>, "
              "confidence string, caption string, keywords array<string>",
    "burst": "best_index string, reject_indices array<string>, note string",
    "bws": "best_index string, worst_index string, note string",
    "pair": "winner string, note string",
}
#: Kinds of value that fields of text and of lists of text may hold.
TEXT, TEXTS = ("STRING",), ("ARRAY<STRING>", "ARRAY<VOID>")
_KINDS = dict.fromkeys(("category", "verdict", "confidence", "caption", "note", "winner"), TEXT) | {
    "reasons": TEXTS, "keywords": TEXTS,
}
_REQUIRED = {
    "triage": ("category", "verdict", "technical_score", "reasons", "confidence"),
    "burst": ("best_index", "reject_indices", "note"),
    "bws": ("best_index", "worst_index", "note"),
    "pair": ("winner", "note"),
}


#: A string, closed or cut off by the end of the text, or a brace.
_MARKS = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\\?\Z)|[{}]', re.DOTALL)


@F.pandas_udf(StringType())
def first_object(texts: pd.Series) -> pd.Series:
    """The first balanced ``{..}`` of each text, null when there is none.

    Braces inside strings do not count and a backslash hides the next character of a string.
    """
    def cut_out(text):
        if text is None:
            return None
        begin, level = text.find("{"), 0
        if begin < 0:
            return None
        for mark in _MARKS.finditer(text, begin):
            level += {"{": 1, "}": -1}.get(mark.group(), 0)
            if level == 0:
                return text[begin:mark.end()]
        return None

    return texts.map(cut_out, na_action="ignore")


def whole_number(text: Column) -> Column:
    """Text of a whole number in plain digits as int; other text is null."""
    plain = F.regexp_extract(text, r"^\s*([+-]?[0-9]+)(?:\.0*)?\s*$", 1)
    return plain.try_cast("int")


def _typed(name: str, parsed: Column) -> Column:
    field = parsed[name]
    if name in ("technical_score", "best_index", "worst_index"):
        return whole_number(field)
    if name == "reject_indices":
        return F.transform(field, whole_number)
    if name == "keywords":
        return normalize_keywords(F.coalesce(field, F.array().cast("array<string>")))
    if name == "caption":
        return F.coalesce(field, F.lit(""))
    return field


def _wrong_kind(name: str) -> Column:
    """Whether the reply gives ``name`` a value that is not of its kind, null included."""
    value = F.try_variant_get("_kinds", f"$.{name}", "variant")
    wrong = ~F.schema_of_variant(value).isin(*_KINDS[name])
    if _KINDS[name] is TEXTS:
        wrong = wrong | F.exists(F.col("_parsed")[name], lambda i: i.isNull())
    return F.coalesce(wrong, F.lit(False))


def parse_replies(df: DataFrame, kind: str, text: str = "reply") -> DataFrame:
    """Add the verdict fields of ``kind`` and ``error`` (null when the reply could be read).

    Text fields must hold text and lists of text only text; a number may be written as text in
    plain digits. An optional field may be missing, but not null. A reply that is a JSON object as a
    whole stays in the engine; only others are sent to :func:`first_object`.
    """
    small_batches(df.sparkSession)
    fields = REPLY_FIELDS[kind]
    names = [part.split()[0] for part in fields.split(", ")]
    parsed = F.from_json(
        "_object", f"{fields}, _corrupt string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
    )
    plain = F.coalesce(F.schema_of_variant("_whole").startswith("OBJECT"), F.lit(False))
    read = (
        df.withColumn("_whole", F.try_parse_json(text)).withColumn("_plain", plain)
        .withColumn("_found", first_object(F.when(~F.col("_plain"), F.col(text))))
        .withColumn("_object", F.when(F.col("_plain"), F.col(text)).otherwise(F.col("_found")))
        .withColumn("_parsed", parsed)
        .withColumn("_kinds", F.when(F.col("_plain"), F.col("_whole")).otherwise(F.try_parse_json("_found")))
        .select(
            *[c for c in df.columns if c not in (*names, "error")],
            *[_typed(n, F.col("_parsed")).alias(n) for n in names],
            F.when(F.col(text).isNull(), "no reply")
            .when(~F.col(text).contains("{"), "no JSON object in reply")
            .when(F.col("_object").isNull(), "unbalanced JSON object in reply")
            .when(F.col("_parsed._corrupt").isNotNull(), "reply is not JSON")
            .alias("error"),
            *[_wrong_kind(n).alias(f"_wrong_{n}") for n in names if n in _KINDS],
        )
    )
    missing = F.lit(None).cast("string")
    for name in names:
        if name in _KINDS:
            missing = F.when(F.col(f"_wrong_{name}"), F.lit(f"wrong type of {name}")).otherwise(
                missing
            )
    for name in _REQUIRED[kind]:
        missing = F.when(F.col(name).isNull(), F.lit(f"missing or unusable {name}")).otherwise(
            missing
        )
    return read.withColumn("error", F.coalesce("error", missing)).drop(
        *[f"_wrong_{n}" for n in names])


def _problems(kind: str, count: Column, strict: bool) -> list[tuple[Column, str]]:
    def inside(index: Column) -> Column:
        return (index >= 1) & (index <= count)

    best = F.col("best_index") if kind in ("burst", "bws") else None
    if kind == "triage":
        return [
            (~F.col("category").isin(*CATEGORIES), "unknown category"),
            (~F.col("verdict").isin(*VERDICTS), "unknown verdict"),
            (~F.col("confidence").isin(*CONFIDENCES), "unknown confidence"),
            (~F.col("technical_score").between(0, 10), "technical_score outside 0-10"),
        ]
    if kind == "burst":
        rejects = F.col("reject_indices")
        checks = [
            (F.exists(rejects, lambda i: i.isNull()), "reject index is not a number"),
            (~inside(best), "best_index out of range"),
        ]
        if strict:
            checks += [
                (F.exists(rejects, lambda i: ~inside(i)), "reject index out of range"),
                (F.array_contains(rejects, best), "best_index is also rejected"),
            ]
        return checks
    if kind == "bws":
        worst = F.col("worst_index")
        return [
            (~inside(best), "best_index out of range"),
            (~inside(worst), "worst_index out of range"),
            (best == worst, "best_index equals worst_index"),
        ]
    return [(~F.col("winner").isin(*PAIR_WINNERS), "unknown winner")]


def checked(df: DataFrame, kind: str, count: Column | None = None, strict: bool = True) -> DataFrame:
    """Set ``error`` for verdicts that break a rule.

    ``count`` is the number of items shown. With ``strict=False`` reject indices that are out of
    range or name the best item pass, since resolving them drops them.
    """
    size = F.lit(1) if count is None else count
    error = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    for broken, message in _problems(kind, size, strict):
        error = F.coalesce(error, F.when(broken, F.lit(message)))
    return df.withColumn("error", error)


def validate_verdicts(
    df: DataFrame, kind: str, count: Column | None = None, strict: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Split into verdicts that hold every rule and rejected rows with their ``error``."""
    rows = checked(df, kind, count, strict)
    return rows.filter(F.col("error").isNull()).drop("error"), rows.filter(
        F.col("error").isNotNull()
    )
