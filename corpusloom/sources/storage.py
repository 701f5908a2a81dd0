"""The folder that a cluster shares, for tables between steps."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Where the tables are that written() gave out.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """From spark.checkpoint.dir; a folder of our own only where that is unset and all runs on this machine, as in tests."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later steps reread it, and lost executors recompute nothing before it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discarded(table: DataFrame) -> None:
    """Delete a table that written() gave out, once all that is made of it has been written itself."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(_paths.pop(table))
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
