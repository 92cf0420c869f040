"""Tables in the folder that driver and executors share: ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Only a single-process session may go without the setting; it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="guardloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def settle(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    context = df.sparkSession.sparkContext
    written = context._jvm.org.apache.hadoop.fs.Path(path)
    written.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(written)
    return df.sparkSession.read.schema(df.schema).parquet(path)
