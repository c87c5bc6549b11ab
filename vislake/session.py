"""Session set-up, table access, checked broadcasts and lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast by hint only if a count proves it to have no more rows than this (dimension rows are short).
BROADCAST_ROWS = 500_000
#: Sides whose size estimate is above this are not even counted.
BROADCAST_ESTIMATE = 64 << 20
#: Estimates from here on mean that the optimizer knows nothing.
UNKNOWN_BYTES = 1 << 60


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless they find it anyway (PYTHONPATH, or the driver's folder)."""
    root = Path(__file__).resolve().parents[1]
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or Path.cwd() == root or getattr(sc, "_vislake_shipped", False):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "vislake"), "zip", root, "vislake")
    sc.addPyFile(archive)
    sc._vislake_shipped = True


def ensure_utc(spark: SparkSession) -> SparkSession:
    """Timestamps without a time zone are taken as UTC everywhere; workers can import this package."""
    ship(spark)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of the input folder (a file or a folder of part files)."""
    ensure_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def estimated_bytes(df: DataFrame) -> int:
    """Size of the plan's output as the optimizer estimates it (no job is run)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, most_rows: int = BROADCAST_ROWS) -> bool:
    """True if a count proves that there are no more rows; it stops one row past the bound."""
    estimate = estimated_bytes(df)
    known = estimate < UNKNOWN_BYTES  # local rows have no estimate; their count is cheap
    return not (known and estimate > BROADCAST_ESTIMATE) and df.limit(most_rows + 1).count() <= most_rows


def bounded(df: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if a count proves the side to be small; else leave the join to Spark (shuffled, split if skewed).

    Meant for dimension tables: the count runs over the side, and stops one row past the bound.
    """
    return F.broadcast(df) if small(df, most_rows) else df


def spread(df: DataFrame) -> DataFrame:
    """Rows over at least as many partitions as there are cores; for few, small files in front of costly kernels."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; on a local master without it, a temporary one."""
    sc = spark.sparkContext
    set_dir = sc._jsc.sc().getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not set_dir.isDefined():
            sc.setCheckpointDir(configured)
        return configured
    if set_dir.isDefined():
        return os.path.dirname(set_dir.get())
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set on this cluster")
    own = "file://" + tempfile.mkdtemp(prefix="vislake-")
    sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and go on from there; unlike cut(), later reads take only the columns
    they need. The table is deleted when the driver ends."""
    spark = df.sparkSession
    home = f"{shared_dir(spark).rstrip('/')}/vislake-table-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(home)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(home)
    return spark.read.schema(df.schema).parquet(home)


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a timestamp with or without a time zone (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def finite(x: Column) -> Column:
    """True for a number that is neither NULL nor NaN nor infinite; never NULL."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    name = f"__{stem}"
    while name in df.columns:
        name += "_"
    return name
