"""Substring search over a store of records by an index of letter triples, which reads what it needs of both.

The index is a table: every place of every searched text with the three letters from there on, in directories by first
letter and sorted within. What was typed is cut into triples that cover it; their postings meet where they stand in the
right distances, which is an exact match. Only the first records in store order are then fetched, by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM, BUCKETS, LIMIT = 3, 64, 60
#: Postings that one task sorts, about.
SORTED = 1 << 21


def searched() -> Column:
    """What is searched of a record: number, name and form number in lower case."""
    return F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("record_no", "ph_name", "form_no"))))


def bucket_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(gram, 1, 1)), F.lit(BUCKETS)).cast("int")


def ranges(text: DataFrame) -> list[int]:
    """[how many ranges postings of the texts t need], where that is more than the session's number of partitions."""
    needed = -(-(text.agg(F.sum(F.length("t"))).first()[0] or 0) // SORTED)
    return [needed] if needed > int(text.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []


def write_index(records: DataFrame, path: str, pos: str = "pos") -> None:
    """Writes the store, in order of `pos`, and its postings (gram, pos, at) below `path`. Texts end with shorter grams,
    so that one or two letters are found as well. Records of blank text have no postings."""
    records.repartitionByRange(pos).sortWithinPartitions(pos).write.parquet(f"{path}/store")
    text = records.select(F.col(pos).cast("long").alias("pos"), searched().alias("t")).where(F.length("t") > 0)
    each = text.select("pos", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: F.substring(F.col("t"), i, F.lit(GRAM)))).alias("at", "gram"))
    order = ["bucket", "gram", "pos", "at"]
    dealt = each.withColumn("bucket", bucket_of(F.col("gram"))).repartitionByRange(*ranges(text), *order).sortWithinPartitions(*order)
    dealt.write.partitionBy("bucket").parquet(f"{path}/postings")


def offsets(needle: str) -> dict[str, list[int]]:
    """Where triples that cover the needle begin, by triple."""
    out: dict[str, list[int]] = {}
    for i in sorted({*range(0, len(needle) - GRAM + 1, GRAM), len(needle) - GRAM}):
        out.setdefault(needle[i : i + GRAM], []).append(i)
    return out


def positions(spark: SparkSession, path: str, needle: str) -> DataFrame:
    """pos of all records whose text holds the needle (lower case, not empty)."""
    postings = spark.read.schema("pos long, at int, gram string, bucket int").parquet(f"{path}/postings")
    if len(needle) < GRAM:
        return postings.where((F.col("bucket") == bucket_of(F.lit(needle))) & F.col("gram").startswith(needle)).select("pos").distinct()
    of = offsets(needle)
    some = postings.where(F.col("bucket").isin([bucket_of(F.lit(g)) for g in of]) & F.col("gram").isin(list(of)))
    where = F.coalesce(*(F.when(F.col("gram") == g, F.array(*map(F.lit, at))) for g, at in of.items()))
    begins = some.select("pos", "at", F.explode(where).alias("o")).groupBy("pos", (F.col("at") - F.col("o")).alias("begin")).agg(F.count("*").alias("n"))
    return begins.where(F.col("n") == sum(map(len, of.values()))).select("pos").distinct()


def search_index(spark: SparkSession, path: str, typed: str, limit: int = LIMIT, pos: str = "pos") -> DataFrame:
    """The first `limit` records in store order whose number, name or form number holds what was typed, case aside.

    Nothing typed gives the first records. The positions found, `limit` at most, go into the filter of the store's scan.
    """
    needle, store = typed.strip().lower(), spark.read.parquet(f"{path}/store")
    if not needle:
        return store.orderBy(pos).limit(limit)
    first = [r.pos for r in positions(spark, path, needle).orderBy("pos").limit(limit).collect()]
    return store.where(F.col(pos).isin(first) & F.contains(searched(), F.lit(needle))).orderBy(pos).limit(limit)
