"""Writers of record tables: CSV, TSV and JSON lines, by all tasks in parallel."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", "\t").option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Only a local session without it gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return path or tempfile.mkdtemp(prefix="formweave-")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: computed once, with a short lineage that survives lost executors.

    The shuffle files of its making go at once, not when the driver happens to collect its garbage.
    """
    spark, option = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(option, None)
    spark.conf.set(option, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(option) if before is None else spark.conf.set(option, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of kept() that nothing will read any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
