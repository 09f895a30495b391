"""Writers: tables by company, upserts, logs, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.operators.vectors import upsert
from tonelake.storage import hadoop_path, scratch, small_enough, stage

#: partitions that one upsert rewrites one by one at most; a batch that touches more rewrites the table
TOUCHED = 10_000


def by_company(df: DataFrame, path: str, column: str = "ticker") -> None:
    """Overwrites the partitions of the companies that df holds, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table. A replacement that was cut off between its two renames is undone first; errors of the file system rise."""
    fs, p = hadoop_path(spark, path)
    if fs.exists(p):
        return True
    parent = p.getParent()
    if fs.exists(parent):
        for one in fs.listStatus(parent):
            if one.getPath().getName().startswith(f"{p.getName()}.old-"):
                fs.rename(one.getPath(), p)
                return True
    return False


def replace_table(spark: SparkSession, path: str, df: DataFrame, partition: str | None = None) -> None:
    """Writes df beside the table and swaps the two by renames: readers see the old rows or the new ones, and a failing write leaves the old."""
    mark = uuid.uuid4().hex
    writer = df.write.partitionBy(partition) if partition else df.write
    writer.parquet(f"{path}.new-{mark}")
    fs, new = hadoop_path(spark, f"{path}.new-{mark}")
    _, old = hadoop_path(spark, f"{path}.old-{mark}")
    _, here = hadoop_path(spark, path)
    if fs.exists(here) and not fs.rename(here, old):
        raise OSError(f"can't move {path}")
    if not fs.rename(new, here):
        fs.rename(old, here)
        raise OSError(f"can't replace {path}")
    if fs.exists(old):
        fs.delete(old, True)


def upsert_table(spark: SparkSession, path: str, incoming: DataFrame, key: str, order: str | None = None, partition: str | None = None) -> None:
    """Replaces rows of the same key; with an order column the row with the greater one stays, stored or incoming.

    Any failure to read the table rises and leaves it as it was. With a partition column, which must not change for a key, only
    the partitions that occur in incoming are read and rewritten.
    """
    with scratch(spark):
        incoming = stage(incoming, "incoming")
        if not table_exists(spark, path):
            replace_table(spark, path, upsert(incoming.limit(0), incoming, key, order), partition)
            return
        old = spark.read.parquet(path)
        touched = incoming.select(partition).distinct() if partition else None
        if touched is not None and small_enough(touched, TOUCHED) and touched.where(F.col(partition).isNull()).isEmpty():
            values = [r[0] for r in touched.collect()]
            merged = stage(upsert(old.where(F.col(partition).isin(values)).select(*incoming.columns), incoming, key, order), "merged")
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        else:
            replace_table(spark, path, upsert(old.select(*incoming.columns), incoming, key, order), partition)


def delete_company(spark: SparkSession, path: str, ticker: str, column: str = "ticker") -> None:
    replace_table(spark, path, spark.read.parquet(path).where(~F.coalesce(F.col(column) == ticker, F.lit(False))))


def append_metrics(df: DataFrame, path: str) -> None:
    """Long metrics (run_id, metric, value) to a log."""
    df.select("run_id", "metric", F.col("value").cast("double").alias("value")).write.mode("append").parquet(path)


def start_run(spark: SparkSession, path: str, run_id: str, params: dict[str, str], started_at: str) -> None:
    """Appends a row (run_id, started_at, params) to the log of runs."""
    row = spark.createDataFrame([(run_id, started_at, params)], "run_id string, started_at string, params map<string, string>")
    row.withColumn("started_at", F.col("started_at").cast("timestamp")).write.mode("append").parquet(path)


def embed_and_store(spark: SparkSession, path: str, chunks: DataFrame, load=None) -> int:
    """Embeds chunks, upserts them by chunk_id, and tells how many were stored; vectors of other chunks stay."""
    from tonelake.operators.models import embed

    with scratch(spark):
        made = stage(embed(chunks, load=load), "vectors")
        upsert_table(spark, path, made, "chunk_id")
        return made.count()


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
