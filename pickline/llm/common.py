"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pickline.session import checkpoint_dir


#: Bytes of rows that go to a Python worker together; both sides hold them, several times over.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the test data; batches of long texts are kept small from here on."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound) == f"{64 << 20}b":  # Spark's default; another value is the user's
        spark.conf.set(bound, f"{BATCH_BYTES}b")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def whole_text(name: str) -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def narrowed(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under fixed names, so that other columns can have any name."""
    return docs.select(*[F.col(f"`{given}`").alias(own) for own, given in columns.items()])
