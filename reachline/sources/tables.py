"""Reading and writing the marketing tables.

No table format is assumed. A table is either one folder of partitions that are replaced
whole, or a root folder of numbered versions of which readers take the newest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachline.sources.schemas import TABLES


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet",
               **options: str) -> DataFrame:
    """A marketing table from files, with its declared schema and no inference."""
    return spark.read.format(fmt).schema(TABLES[name]).options(**options).load(path)


def read_database(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int,
                  partitions: int, **options: str) -> DataFrame:
    """A table from a relational database, read in parallel key ranges.

    Filters and column selection reach the database; ``key`` must be numeric.
    """
    return (spark.read.format("jdbc")
            .options(url=url, dbtable=table, partitionColumn=key, lowerBound=lower,
                     upperBound=upper, numPartitions=partitions, **options)
            .load())


def write_outbound(messages: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Send payloads, one folder per campaign.

    Only the campaigns in ``messages`` are replaced, so a repeated run writes the same
    table. Rows are gathered by campaign to avoid a file per task and campaign; a campaign
    holding most rows is split again at run time.
    """
    (messages.hint("rebalance", "campaign_id").write.mode("overwrite")
     .partitionBy("campaign_id").option("partitionOverwriteMode", "dynamic")
     .option("maxRecordsPerFile", rows_per_file).parquet(path))


def append_rows(rows: DataFrame, path: str) -> None:
    """Adds rows, such as newly generated segments, to a stored table."""
    rows.write.mode("append").parquet(path)


def write_version(table: DataFrame, root: str, version: int) -> None:
    """Adds one whole version of a table. Readers see it only once it is complete."""
    table.write.mode("overwrite").parquet(f"{root}/version={version}")


def _folders(spark: SparkSession, root: str, name: str, above: int | None,
             below: int | None) -> tuple[object, list[tuple[int, object]]]:
    """The file system and the folders ``name=n`` below ``root`` with above < n < below: one
    listing. Spark's own file system classes are called, so this needs a classic session."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return files, []
    found = [status.getPath() for status in files.listStatus(path)]
    numbered = [(int(p.getName().partition("=")[2]), p) for p in found
                if p.getName().startswith(f"{name}=")]
    return files, sorted((n, p) for n, p in numbered
                         if (above is None or n > above) and (below is None or n < below))


def complete_folders(spark: SparkSession, root: str, name: str, above: int | None = None,
                     below: int | None = None) -> list[int]:
    """The numbers n of the folders ``name=n`` below ``root`` that have a success marker, in
    order; only those between the bounds are probed."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files, found = _folders(spark, root, name, above, below)
    return [n for n, p in found if files.exists(marker(p, "_SUCCESS"))]


def remove_folders(spark: SparkSession, root: str, name: str, below: int) -> None:
    """Removes the folders ``name=n`` with smaller numbers."""
    files, found = _folders(spark, root, name, None, below)
    for _, path in found:
        files.delete(path, True)


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    """The newest complete version below ``root``: chosen by folder name among those with a
    success marker, so neither older versions nor one being written are read."""
    versions = complete_folders(spark, root, "version")
    if not versions:
        raise ValueError(f"no complete version below {root}")
    return spark.read.parquet(f"{root}/version={max(versions)}")
