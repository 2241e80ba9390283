"""Record snapshots as JSON files: each write is a new snapshot, readers take the newest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "array<map<string,string>>"


def list_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """name of each JSON file in a folder; the contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    return files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "path")


def active_snapshot(spark: SparkSession, folder: str, default: str) -> str | None:
    """Path of the last scraped_*.json by name, else of the default file, else None. One name comes to the driver."""
    files = list_snapshots(spark, folder)
    newest = files.where(F.col("name").like("scraped\\_%.json")).agg(F.max_by("path", "name")).first()[0]
    row = files.where(F.col("name") == default).select("path").first() if newest is None else None
    return newest or (row.path if row else None)


def read_records(spark: SparkSession, path: str | None) -> DataFrame:
    """pos, raw (map) of the records of a JSON array file; none without a file. Values are text, null is empty."""
    if path is None:
        return spark.createDataFrame([], "pos long, raw map<string,string>")
    text = spark.read.option("wholetext", True).text(path)
    rows = text.select(F.posexplode(F.from_json("value", RAW)).alias("pos", "raw"))
    return rows.select(F.col("pos").cast("long").alias("pos"), F.transform_values("raw", lambda _, v: F.coalesce(v, F.lit(""))).alias("raw"))


def write_snapshot(records: DataFrame, folder: str, stamp: str) -> str:
    """Writes records (pos, raw) as one more snapshot, a table partitioned by its time stamp; earlier ones stay."""
    path = f"{folder}/snapshots"
    records.withColumn("snapshot_ts", F.lit(stamp)).write.mode("append").partitionBy("snapshot_ts").parquet(path)
    return path


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the newest snapshot of the table; only its partition is read."""
    table = spark.read.option("partitionOverwriteMode", "static").schema("pos long, raw map<string,string>, snapshot_ts string").parquet(f"{folder}/snapshots")
    newest = table.agg(F.max("snapshot_ts")).first()[0]
    return table.where(F.col("snapshot_ts") == newest).drop("snapshot_ts")


def ingest(spark: SparkSession, path: str, folder: str, stamp: str) -> str:
    """Takes an uploaded file of records (.json, or .xlsx with a header row) as a new snapshot; others are refused.

    A file that holds no list of records, or an empty one, is refused too. Old .xls files are named by the same
    gate, but cannot be read.
    """
    name = path.lower()
    if name.endswith(".json"):
        records = read_records(spark, path)
    elif name.endswith((".xlsx", ".xls")):
        from .xlsx import read_records as read_sheet

        sheet = read_sheet(spark, path)
        keys = [c for c in sheet.columns if c not in ("sheet", "pos")]
        records = sheet.select(F.col("pos").cast("long").alias("pos"), F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(F.col(k) for k in keys))).alias("raw"))
    else:
        raise ValueError("only .json or .xlsx files are accepted")
    if records.isEmpty():
        raise ValueError("the file holds no list of records, or an empty one")
    return write_snapshot(records.select("pos", "raw"), folder, stamp)
