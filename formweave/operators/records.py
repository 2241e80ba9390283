"""The record store: schema alignment, lookup, search, upsert, exports and status over snapshots of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from formweave.catalog import ALIASES, KEYS, LABEL
from formweave.functions.text import digits


def align_schema(raw: DataFrame, column: str = "raw", keys: list[str] | None = None) -> DataFrame:
    """raw (a map column) as one column for each field: the export's key first, else the field's own; null if neither."""
    value = lambda k: F.element_at(column, F.lit(k))
    has = lambda k: F.map_contains_key(column, F.lit(k))
    of = {k: F.when(has(ALIASES.get(k, k)), value(ALIASES.get(k, k))).otherwise(value(k)) for k in keys or KEYS}
    return raw.select(*(c for c in raw.columns if c != column), *(v.alias(k) for k, v in of.items()))


def map_headers(headers: DataFrame, names: DataFrame) -> DataFrame:
    """headers (sheet, col, header) with the field that each column holds; unknown columns are left out.

    The later of two columns for one field wins. Without a record_no column, the first `id` column stands for it.
    """
    clean = headers.withColumn("name", F.lower(F.trim("header")))
    found = clean.join(names, "name").select("sheet", "col", "key")
    ids = clean.where("name = 'id'").groupBy("sheet").agg(F.min("col").alias("col"))
    have = found.where("key = 'record_no'").select("sheet").distinct()
    spare = ids.join(have, "sheet", "left_anti").select("sheet", "col", F.lit("record_no").alias("key"))
    return found.unionByName(spare).groupBy("sheet", "key").agg(F.max("col").alias("col"))


def lookup(records: DataFrame, wanted: DataFrame, pos: str = "pos") -> DataFrame:
    """For each `wanted` key the record it names: an exact number first, else the first in store order that holds the
    key or has the same digits; found is null where nothing fits.

    All tiers are hash joins: on the number, on its digits, and for keys inside numbers on all substrings of the
    numbers that have the length of a key. Substrings travel with the place of their first record alone; the records
    named in the end are fetched by their places.
    """
    keys = wanted.select("key").distinct().withColumns({"k": F.lower(F.trim("key"))}).withColumn("d", digits(F.col("k")))
    store = records.select(F.lower(F.coalesce("record_no", F.lit(""))).alias("r"), F.col("record_no").alias("found"), F.col(pos).alias("p")).withColumn("rd", digits(F.col("r")))
    first = lambda df, tier: df.groupBy("key").agg(F.min_by("found", "p").alias("found"), F.min("p").alias("p")).withColumn("tier", F.lit(tier))
    exact = first(keys.join(store, F.col("k") == F.col("r")), 1)
    open_ = keys.join(exact.select("key"), "key", "left_anti").where("k <> ''")
    same = open_.where("d <> ''").join(store, F.col("d") == F.col("rd"))
    lengths = open_.agg(F.collect_set(F.length("k")).alias("ns"))  # one row, of as many values as keys have lengths
    parts = store.join(F.broadcast(lengths)).select("p", "r", F.explode("ns").alias("n")).where("n <= length(r)")
    parts = parts.select("p", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("r") - F.col("n") + 1), lambda i: F.substring(F.col("r"), i, F.col("n"))))).alias("part"))
    # the first record of each substring is all that can be found
    parts = parts.groupBy("part").agg(F.min("p").alias("p"))
    within = open_.join(parts, F.col("k") == F.col("part")).select("key", "k", "p")
    within = within.join(store.select("p", "r", "found"), "p").where(F.contains("r", "k"))  # others may have the same place
    loose = first(same.select("key", "found", "p").union(within.select("key", "found", "p")), 2)
    return wanted.join(exact.unionByName(loose), "key", "left")


def search(records: DataFrame, typed: str, limit: int = 60, pos: str = "pos") -> DataFrame:
    """The first records in store order whose number, name or form number holds what was typed, case aside."""
    text = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("record_no", "ph_name", "form_no"))))
    return records.where(F.contains(text, F.lit(typed.strip().lower()))).orderBy(pos).limit(limit)


def upsert(records: DataFrame, changes: DataFrame, pos: str = "pos") -> DataFrame:
    """records with each change in place of the first record of the same trimmed number, or after all others.

    Changes without a number are refused by leaving them out; the last of several for one number (by pos) counts.
    """
    key = F.trim("record_no")
    last = F.row_number().over(W.partitionBy("_k").orderBy(F.desc(pos)))
    new = changes.withColumn("_k", key).where("_k is not null and _k <> ''").withColumn("_n", last).where("_n = 1").drop("_n")
    old = records.withColumn("_k", key)
    spot = old.groupBy("_k").agg(F.min(pos).alias("_first")).join(new.select("_k"), "_k", "left_semi")
    kept = old.join(spot, (old["_k"] == spot["_k"]) & (old[pos] == spot["_first"]), "left_anti")
    end = records.agg(F.coalesce(F.max(pos), F.lit(-1)).alias("_end"))
    placed = new.join(spot, "_k", "left").join(F.broadcast(end))
    placed = placed.withColumn(pos, F.coalesce(F.col("_first"), F.col("_end") + 1 + F.col(pos)))
    return kept.drop("_k").unionByName(placed.select(*records.columns))


def store_status(snapshots: DataFrame) -> DataFrame:
    """snapshots (name) as one row: active file, whether it was scraped, number, last time, kinds and the oldest name.

    The names themselves, from the newest on, are snapshot_history().
    """
    time = F.try_to_timestamp(F.regexp_extract("name", r"^scraped_([0-9]{8}_[0-9]{6})\.json$", 1), F.lit("yyyyMMdd_HHmmss"))
    scraped = snapshots.where("name like 'scraped\\_%.json'")
    return scraped.agg(F.max("name").alias("active"), (F.count("*") > 0).alias("is_scraped"), F.count("*").alias("n"), F.max(time).alias("last"), F.countDistinct("name").alias("kinds"), F.min("name").alias("oldest"))


def snapshot_history(snapshots: DataFrame) -> DataFrame:
    """Names of scraped snapshots from the newest on, sorted across tasks."""
    return snapshots.where("name like 'scraped\\_%.json'").select("name").orderBy(F.desc("name"))


def by_mapping(results: DataFrame, mapped: bool, matched: str = "matched") -> DataFrame:
    """The forms that a record was found for, or the others."""
    return results.where(F.coalesce(F.col(matched), F.lit(False)) == mapped)


def extra_columns(raw: DataFrame, column: str = "raw", pos: str = "pos", known: list[str] | None = None) -> DataFrame:
    """Keys of a map column that are no known ones, in the order in which they are first seen."""
    keys = raw.select(F.col(pos).alias("p"), F.posexplode(F.map_keys(column)).alias("i", "key"))
    keys = keys.where(~F.col("key").isin(known if known is not None else [ALIASES.get(k, k) for k in KEYS]))
    first = keys.groupBy("key").agg(F.min(F.struct("p", "i")).alias("at"))
    return first.select("key", F.row_number().over(W.orderBy("at.p", "at.i", "key")).alias("place"))


def export_table(raw: DataFrame, extras: list[str], column: str = "raw", pos: str = "pos") -> DataFrame:
    """The known fields under their labels, then the extra columns; what is missing is an empty text."""
    cell = lambda k: F.coalesce(F.element_at(column, F.lit(k)), F.lit(""))
    return raw.orderBy(pos).select(*(cell(ALIASES.get(k, k)).alias(LABEL[k]) for k in KEYS), *(cell(k).alias(k) for k in extras))


def learn_vocabulary(records: DataFrame, keys: list[str]) -> DataFrame:
    """key, value: distinct trimmed upper-case values of the fields, empty ones left out."""
    long = records.select(F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.upper(F.trim(F.col(k))).alias("value")) for k in keys))).alias("x"))
    return long.select("x.*").where("value is not null and value <> ''").distinct()


def is_missing(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""
