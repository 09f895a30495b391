"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: paths staged within open scratch() blocks, the innermost last
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is named, a temporary folder of this machine serves a local session; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tonelake-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and no executor holds the only copy.

    The table goes when a surrounding scratch() ends, at the latest with the driver's JVM (also after the session was stopped).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tonelake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = hadoop_path(spark, path)
    fs.deleteOnExit(p)
    if _OPEN:
        _OPEN[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    if path := getattr(df, "_staged_at", None):
        fs, p = hadoop_path(df.sparkSession, path)
        fs.delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged within the block are deleted at its end; what is computed from them must be written by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            fs, p = hadoop_path(spark, path)
            fs.delete(p, True)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than rows + 1 of them."""
    return df.limit(rows + 1).count() <= rows


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files are fewer than those; a table with enough files is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """df partitioned by keys, over so many partitions that small ones aren't put together before costly work on rows; an aggregation by the keys that follows needs no further shuffle."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


#: keys that occur more than once, broadcast at most; more are joined by a shuffle
REPEATED_KEYS = 1_000_000


def one_of_each(df: DataFrame, keys: list[str], least: str) -> DataFrame:
    """df with one row for each key, of several rows the one that is least by a column and then by all others.

    Keys are counted first, from their own columns alone; only rows of keys that occur more than once are shuffled. Rows with a null in a key are left out.
    """
    df = df.dropna(subset=keys)
    repeated = df.groupBy(*keys).count().where("count > 1").select(*keys)
    repeated = F.broadcast(repeated) if small_enough(repeated, REPEATED_KEYS) else repeated
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(least).isNull(), least, *[c for c in rest if c != least])
    several = df.join(repeated, keys, "left_semi").groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")
    return df.join(repeated, keys, "left_anti").select(*keys, *rest).unionByName(several).select(*df.columns)
