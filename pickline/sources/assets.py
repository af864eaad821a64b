"""Asset metadata: reading, windows and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pickline.functions.scalars import bound_literal, camera_key, capture_time
from pickline.schemas import ASSETS, align

#: Nested input document; only the fields the engine uses are read.
ASSET_DOCUMENT = (
    "id string, originalFileName string, type string, localDateTime string, "
    "fileCreatedAt string, rating int, "
    "exifInfo struct<make:string, model:string, exifImageWidth:int, exifImageHeight:int, "
    "dateTimeOriginal:string, rating:int, description:string>, dhash bigint, thumb_path string"
)


def flatten_assets(documents: DataFrame) -> DataFrame:
    """Nested asset documents as ``assets`` rows; rows without id or not an image are left out."""
    exif = F.col("exifInfo")
    rows = documents.filter(
        (F.coalesce("id", F.lit("")) != "") & (F.col("type").isNull() | (F.col("type") == "IMAGE"))
    ).select(
        "id",
        F.col("originalFileName").alias("filename"),
        _taken(exif).alias("taken_at"),
        camera_key(exif["make"], exif["model"]).alias("camera"),
        F.when(exif["description"] != "", exif["description"]).alias("description"),
        exif["exifImageWidth"].alias("width"),
        exif["exifImageHeight"].alias("height"),
        F.coalesce(exif["rating"], F.col("rating")).alias("source_rating"),
        "dhash",
        "thumb_path",
        F.current_timestamp().alias("scanned_at"),
    )
    return align(rows, ASSETS)


def _taken(exif: Column) -> Column:
    return capture_time(exif["dateTimeOriginal"], F.col("fileCreatedAt"), F.col("localDateTime"))


def write_documents(documents: DataFrame, path: str, fmt: str = "json") -> None:
    """Store nested asset documents in a folder per UTC day of capture, which readers can skip."""
    documents.withColumn("day", F.to_date(_taken(F.col("exifInfo")))).write.partitionBy("day").format(fmt).save(path)


def read_assets(spark: SparkSession, path: str, fmt: str = "json", after=None, before=None) -> DataFrame:
    """Asset documents under ``path`` (json or parquet) as ``assets`` rows.

    With a window, ``after <= taken_at < before``, rows without a time are left out, and where the
    documents lie in folders by ``day`` only those of the window are listed for reading.
    """
    documents = spark.read.schema(ASSET_DOCUMENT).format(fmt).load(path)
    if "day" in documents.columns:
        if after is not None:
            documents = documents.filter(F.col("day") >= F.to_date(bound_literal(after)))
        if before is not None:
            documents = documents.filter(F.col("day") <= F.to_date(bound_literal(before)))
    return time_window(flatten_assets(documents), after=after, before=before)


def time_window(
    df: DataFrame, ts: str = "taken_at", after=None, before=None
) -> DataFrame:
    """Rows with ``after <= ts < before``; a missing side is open.

    Bounds are dates, datetimes or ISO text. They become literals of the column's own type, so
    the parquet scan can skip row groups.
    """
    kind = df.schema[ts].dataType

    def typed(value) -> Column:
        return bound_literal(value).cast(kind)

    if after is not None:
        df = df.filter(F.col(ts) >= typed(after))
    if before is not None:
        df = df.filter(F.col(ts) < typed(before))
    return df


def lookup(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is in ``ids``, oldest first; unknown and repeated ids do not matter."""
    return df.join(ids.select(key), key, "left_semi").orderBy("taken_at", key)
