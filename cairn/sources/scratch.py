"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def fresh_path(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; below a local folder only where that is unset and Spark runs in one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = local_folder()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written as Parquet to the shared folder and read again: lineage ends here, and a lost executor costs nothing."""
    path = fresh_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def large(df: DataFrame) -> DataFrame:
    """df as a side of a join that moves both sides. Spark sizes a stored table by its compressed files, and what an explode or a function of Arrow batches makes by what goes in, so that it may broadcast many times its limit."""
    return df.hint("merge")


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more; all that was made of them must be stored by now."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(conf).delete(path, True)
