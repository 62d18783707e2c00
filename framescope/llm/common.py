"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HELD_OUT_REMAINDER = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT_REMAINDER, F.lit(False))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def floored(x: Column, scale: float) -> Column:
    """floor(scale * x) as a long. Past 2**53 doubles are no longer whole numbers apart: that fails the job."""
    y = x.cast("double") * scale
    return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("long")).otherwise(F.raise_error(F.lit("a scaled vector component passes 2**53")).cast("long"))


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that all executors share, spark.checkpoint.dir. Where none is
    named, a local session gets a folder that goes with the process; a cluster has none to offer."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        at = tempfile.mkdtemp(prefix="framescope-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(at)
    return f"{at}/{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost executor
    costs no more than the files' reread, and later uses do not compute it again. The table stays as long
    as results may be read from it: the application's folder can go when the application has ended."""
    at = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
