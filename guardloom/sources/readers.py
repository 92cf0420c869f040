"""Tables, texts and results in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out when a few files would leave most cores idle; large inputs, which have
    more partitions than cores anyway, are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_texts(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """(path, text): a row per file, or per line."""
    rows = spark.read.text(path, wholetext=whole)
    return rows.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_rpc_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON-RPC lines as ``body``; what is not JSON is kept for the parser to answer."""
    return spark.read.text(path).select(F.col("value").alias("body"))


def write_results(df: DataFrame, path: str) -> None:
    """Results as JSON lines."""
    df.write.json(path)


def write_audit(checked: DataFrame, path: str) -> None:
    """Rows that were blocked or are not safe, as Parquet."""
    checked.where("blocked OR NOT is_safe").write.mode("append").parquet(path)
