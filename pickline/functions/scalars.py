"""Column functions. All are built-in expressions and stay inside generated code."""

from __future__ import annotations

from datetime import UTC, date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from pickline.schemas import WORK_KINDS

# Seconds per interval unit, shape of a work id, length of a group key.
INTERVAL_SECONDS = {"s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0, "w": 604800.0}
WORK_ID_PATTERN = "^[a-zA-Z0-9_-]{1,64}$"
GROUP_KEY_HEX = 12
MAX_KEYWORDS = 8

# The characters that count as white space, also understood by other regex engines.
BLANK = (
    r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
_NUMBER = r"[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?"


def strip(col: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(col, f"^{BLANK}|{BLANK}$", "")


def capture_time(*cols: Column) -> Column:
    """The first parseable timestamp; text without a zone is UTC, junk is null.

    An ISO date, optionally with a time and a zone, is accepted; other text is not.
    """
    iso = (
        r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?"
        r"([+-]\d{2}:\d{2}(:\d{2})?|[zZ])?)?$"
    )

    def parse(col: Column) -> Column:
        text = F.regexp_replace(strip(col), "[zZ]$", "+00:00")
        text = F.regexp_replace(text, ",", ".")
        text = F.regexp_replace(text, r"([T ]\d{2}:\d{2})($|[+-])", "$1:00$2")
        zoned = F.when(text.rlike(r"[+-]\d{2}:\d{2}(:\d{2})?$") & text.rlike(r":\d{2}.*[+-]\d{2}:"),
                       text)
        utc = F.when(zoned.isNull() & text.rlike(r"[T ]"), F.concat(text, F.lit("+00:00")))
        day = F.concat(text, F.lit("T00:00:00+00:00"))
        return F.when(strip(col).rlike(iso), F.try_to_timestamp(F.coalesce(zoned, utc, day)))

    return F.coalesce(*[parse(c) for c in cols])


def camera_key(make: Column, model: Column) -> Column:
    """``make|model`` without outer blanks; empty when neither is known."""
    make, model = (strip(F.coalesce(c, F.lit(""))) for c in (make, model))
    return F.when((make == "") & (model == ""), "").otherwise(F.concat_ws("|", make, model))


def iso_bound(col: Column, is_timestamp: bool = False) -> Column:
    """A search bound as ISO text: bare dates become midnight UTC, other text is kept."""
    if is_timestamp:
        return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    text = strip(col)
    return F.when(text.rlike(r"^.{4}-.{2}-.{2}$"), F.concat(text, F.lit("T00:00:00.000Z"))).otherwise(
        text
    )


def bound_literal(value: str | date | datetime | None) -> Column | None:
    """A window bound as a typed literal, so that it can be pushed to the scan."""
    if value is None:
        return None
    if isinstance(value, datetime):
        moment = value if value.tzinfo else value.replace(tzinfo=UTC)
    elif isinstance(value, date):
        moment = datetime(value.year, value.month, value.day, tzinfo=UTC)
    else:
        moment = datetime.fromisoformat(value.strip())
        moment = moment if moment.tzinfo else moment.replace(tzinfo=UTC)
    return F.lit(moment)


def interval_seconds(col: Column) -> Column:
    """``90s 30m 6h 7d 1w`` or a bare number as seconds; anything else is null."""
    text = F.lower(strip(col))
    factor = F.lit(1.0)
    for unit, seconds in INTERVAL_SECONDS.items():
        factor = F.when(text.endswith(unit), F.lit(seconds)).otherwise(factor)
    value = F.regexp_replace(text, "[smhdw]$", "")
    value = F.when(strip(value).rlike(f"^{_NUMBER}$"), strip(value).cast("double"))
    return F.when(value > 0, value * factor)


def interval_literal(text: str) -> float:
    """An interval option in seconds; junk is an error."""
    cleaned = text.strip().lower()
    unit = cleaned[-1:] if cleaned[-1:] in INTERVAL_SECONDS else ""
    try:
        value = float(cleaned[: len(cleaned) - len(unit)])
    except ValueError:
        raise ValueError(f"cannot parse interval {text!r}") from None
    if not value > 0:
        raise ValueError("the interval must be positive")
    return value * INTERVAL_SECONDS.get(unit, 1.0)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def dhash_bits(grid: Column, hash_size: int = 8) -> Column:
    """Hash of a row-major grid of ``hash_size`` rows and ``hash_size + 1`` columns.

    One bit per cell and right neighbour, most significant first; 64 bits fill a bigint.
    """
    if not 1 <= hash_size <= 8:
        raise ValueError(f"hash_size must be 1 to 8, got {hash_size}")
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(hash_size * hash_size - 1)),
        lambda i: (i + F.floor(i / hash_size)).cast("int"),
    )
    whole = F.size(grid) >= hash_size * (hash_size + 1)
    return F.when(whole, F.aggregate(
        cells,
        F.lit(0).cast("bigint"),
        lambda acc, i: F.shiftleft(acc, 1).bitwiseOR(
            F.when(F.get(grid, i) > F.get(grid, i + 1), 1).otherwise(0).cast("bigint")
        ),
    ))


def normalize_keywords(arr: Column) -> Column:
    """Lower case, single blanks, no empties, first occurrences, at most eight."""
    def clean(word: Column) -> Column:  # most words have no blanks: one match is enough for them
        spaced = strip(F.regexp_replace(F.lower(word), BLANK, " "))
        return F.when(word.rlike(BLANK), spaced).otherwise(F.lower(word))

    words = F.transform(arr, clean)
    return F.slice(F.array_distinct(F.filter(words, lambda w: w != "")), 1, MAX_KEYWORDS)


def group_key(members: Column) -> Column:
    """A key that depends only on the set of members, whatever their order."""
    digest = F.sha1(F.array_join(F.array_sort(members), "\n"))
    return F.concat(F.lit("b"), F.substring(digest, 1, GROUP_KEY_HEX))


def triage_bucket(category: Column, verdict: Column, confidence: Column) -> Column:
    """The decision a single verdict leads to; only sure calls leave the middle."""
    sure = confidence == "high"
    return (
        F.when(sure & (category != "photo"), "nonphoto")
        .when(sure & (verdict == "reject"), "reject")
        .otherwise("middle")
    )


def make_work_id(kind: Column, key: Column) -> Column:
    """``<kind>_<key>``, null when it is not a legal work id."""
    work_id = F.concat_ws("_", kind, key)
    return F.when(work_id.rlike(WORK_ID_PATTERN), work_id)


def work_kind(work_id: Column, default: Column) -> Column:
    """The kind named by the prefix, or ``default`` when the prefix is not a known kind."""
    prefix = F.substring_index(work_id, "_", 1)
    return F.when(prefix.isin(*WORK_KINDS), prefix).otherwise(default)


def work_key(work_id: Column) -> Column:
    """What follows a known kind's prefix; the whole id otherwise."""
    prefix = F.substring_index(work_id, "_", 1)
    known = prefix.isin(*WORK_KINDS) & work_id.contains("_")
    return F.when(known, F.substring(work_id, F.length(prefix) + 2, F.length(work_id))).otherwise(
        work_id
    )


def decode_detail(col: Column) -> Column:
    """JSON text as a variant; text that is not JSON as a string variant."""
    quoted = F.variant_get(F.parse_json(F.to_json(F.struct(col.alias("raw")))), "$.raw", "variant")
    return F.coalesce(F.try_parse_json(col), quoted)


def detail_text(col: Column, path: str) -> Column:
    """One field of a detail document as text; null when absent or not JSON."""
    return F.get_json_object(col, path)


def star_glyphs(stars: Column) -> Column:
    """Zero to five filled stars."""
    count = F.greatest(F.lit(0), F.least(F.lit(5), F.coalesce(stars.cast("int"), F.lit(0))))
    return F.repeat(F.lit("★"), count)


def three_decimals(value: Column) -> Column:
    """A non-negative double with three decimals, rounded by its exact binary value.

    ``format_string`` rounds the shortest decimal text instead, which differs when that text ends
    in a five. Twice the thousandths are an odd whole number only next to a tie; the rounding
    error of that product, computed exactly from a split of the factor, tells the side.
    """
    twice = value * 2000.0
    high = value * 134217729.0 - (value * 134217729.0 - value)
    error = (high * 2000.0 - twice) + (value - high) * 2000.0
    tie = (twice == F.floor(twice)) & (twice % 2 == 1)
    down, up = F.floor((twice - 1) / 2), F.floor((twice + 1) / 2)
    even = F.when(down % 2 == 0, down).otherwise(up)
    n = F.when(
        tie, F.when(error > 0, up).when(error < 0, down).otherwise(even)
    ).otherwise(F.floor(twice / 2 + 0.5))
    return F.format_string("%d.%03d", F.floor(n / 1000), n % 1000)


def score_line(stars: Column, rank: Column, score: Column) -> Column:
    """``★★★★★ · rank 1 · score 2.345`` with absent parts left out."""
    glyphs = star_glyphs(stars)
    return F.concat_ws(
        " · ",
        F.when(glyphs != "", glyphs),
        F.concat(F.lit("rank "), rank.cast("string")),
        F.when(score.isNotNull(), F.concat(F.lit("score "), three_decimals(score))),
    )


def reasons_line(reasons: Column) -> Column:
    """Reasons as one sentence."""
    return F.coalesce(F.array_join(reasons, "; "), F.lit(""))


def verdict_line(verdict: Column, score: Column, confidence: Column) -> Column:
    """``candidate · score 8/10 · high confidence`` with absent parts left out."""
    return F.concat_ws(
        " · ",
        F.when(verdict != "", verdict),
        F.concat(F.lit("score "), score.cast("string"), F.lit("/10")),
        F.when(confidence != "", F.concat(confidence, F.lit(" confidence"))),
    )
