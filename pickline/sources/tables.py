"""The table set on parquet, and the action plan as a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pickline.schemas import TABLES, align, empty

#: The last table of a version: where each table's rows lie. Written when all others are.
LISTING = "_tables"


def _found(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return files, hadoop


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a version was written to its end."""
    files, marker = _found(spark, f"{path}/{LISTING}/_SUCCESS")
    return files.exists(marker)


def table_paths(spark: SparkSession, path: str) -> dict[str, str]:
    """Where the tables of a committed version lie; at most one entry per table."""
    if not committed(spark, path):
        raise FileNotFoundError(f"no committed version of the tables at {path}")
    return {r.name: r.path for r in spark.read.parquet(f"{path}/{LISTING}").collect()}


def save_tables(
    tables: dict[str, DataFrame],
    path: str,
    mode: str = "errorifexists",
    kept: dict[str, str] | None = None,
) -> None:
    """Write the tables as a new version under ``path``.

    Tables in ``kept`` did not change and stay where an older version has them. The listing of all
    tables is written last, and a version without it can't be loaded, so a failure between two
    tables leaves no half version to read. A version must not exist yet: a plan that still reads an
    older one would lose its input. Only a repeated micro-batch overwrites what its first,
    unfinished run began.
    """
    places = dict(kept or {})
    spark = None
    for name, df in tables.items():
        spark = df.sparkSession
        if name not in places:
            align(df, TABLES[name]).write.mode(mode).parquet(f"{path}/{name}")
            places[name] = f"{path}/{name}"
    if spark is not None:
        listing = spark.createDataFrame(sorted(places.items()), "name string, path string")
        listing.coalesce(1).write.mode(mode).parquet(f"{path}/{LISTING}")


def load_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Read a committed version; unlisted tables are empty, absent columns are typed nulls.

    A version that is absent or was not written to its end is an error.
    """
    places = table_paths(spark, path)
    return {
        name: align(spark.read.parquet(places[name]), schema) if name in places
        else empty(spark, schema)
        for name, schema in TABLES.items()
    }


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the committed versions below ``path``, ascending."""
    files, folder = _found(spark, path)
    if not files.exists(folder):
        return []
    numbers = [int(s.getPath().getName()) for s in files.listStatus(folder)
               if s.getPath().getName().isdigit()]
    return sorted(n for n in numbers if committed(spark, f"{path}/{n}"))


def write_actions(plan: DataFrame, path: str, dry_run: bool = True) -> DataFrame:
    """Write the selected plan by group; a dry run only returns it."""
    if not dry_run:
        plan.write.mode("errorifexists").partitionBy("group").parquet(path)
    return plan
