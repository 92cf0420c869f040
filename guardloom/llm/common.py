"""What the corpus operators share: reading, shared storage, word rules."""

from __future__ import annotations

import atexit
import functools
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of every contract in this folder: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch at most: texts are long, and a batch is held by the JVM and by Python.
ROWS_PER_BATCH = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def modest_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to ROWS_PER_BATCH if it is larger or unlimited."""
    now = int(spark.conf.get(_BATCH))
    if now <= 0 or now > ROWS_PER_BATCH:
        spark.conf.set(_BATCH, str(ROWS_PER_BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a single-process session (``local`` or ``local[n]``) may go without; it
    gets a temporary folder, which cannot be seen by anyone else there.
    """
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


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a reread and not a recomputation,
    and non-deterministic steps are settled once.  The table goes when the session's JVM ends.
    """
    spark = df.sparkSession
    modest_batches(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    context = spark.sparkContext
    written = context._jvm.org.apache.hadoop.fs.Path(path)
    written.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(written)
    return spark.read.schema(df.schema).parquet(path)


def release(table: DataFrame) -> None:
    """Deletes the files of a table that materialise() wrote, once nothing reads it any more."""
    context = table.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def lean(run):
    """Wraps a generator over Arrow batches so that its worker gives freed memory back at the end.

    Workers wait for the next stage; what their allocators keep meanwhile counts on top of
    what other workers of the executor use.
    """

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            import pyarrow

            pyarrow.default_memory_pool().release_unused()
            try:
                import ctypes

                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def word_count(text: Column) -> Column:
    """Words of ``text``; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
