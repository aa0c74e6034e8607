"""Reading the corpus tables and finding the shared folder for intermediate tables."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes of an Arrow batch, whatever its rows.
BATCH_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where that is unset, and the session is one process (a test), a temporary folder is made and set; elsewhere it is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        found = sc.getCheckpointDir()
    if not found:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="symgraph-checkpoint-")
        sc.setCheckpointDir(found)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back; this cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/symgraph/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a ``shared_table`` that nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have the driver drop shuffle files of plans that nobody holds any more; else they stay until its next collection.

    The plan that ran last is held a little longer, by the events that tell of its end, hence the second time.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def only(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Just the named columns, so that others of the same name as a helper column can't clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(df: DataFrame, name: str) -> str:
    """name, made longer until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch, for a row may hold a long text: batches of 10,000 such rows would fill a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def texts(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """(doc_id bigint, text string), without rows whose id or text is null."""
    small_batches(docs.sparkSession)
    text = F.col("text") if text is None else text
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.cast("string").alias("text")).where(
        F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    )
