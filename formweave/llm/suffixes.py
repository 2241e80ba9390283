"""Substring dedup with a sparse suffix array: suffixes at minimiser positions are sorted and neighbours compared."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, keep, load
from .repeats import KEY, covered, distinct_segments, repeated_segments, sampled_positions, segments, sharing

#: Least words of a repeated passage, and words that retained suffixes are sorted by.
LEAST_WORDS = 50
SORT_WORDS = 8


def repeated_passages(docs: DataFrame, least: int = LEAST_WORDS, k: int = SORT_WORDS) -> DataFrame:
    """doc_id, n_repeated (words in repeated passages) and passages (array of struct(begin, end, copies)), one row
    for each row of docs that has any.

    A passage is a longest run of words all covered by stretches of `least` words whose words also stand elsewhere,
    in the same text or another; copies is the largest number of places of one of its parts. Every stretch of
    `least` words holds a retained suffix with k words to go, so matching neighbours among these, sorted by these
    words, find each of them. From there a match is extended left and right: a segment is all stretches around one
    retained suffix; equal segments agree in all of them, the others are compared stretch by stretch. Null texts have
    no words; repeated rows repeat each other; null ids are ids like others.
    """
    docs = docs.select("doc_id", "text")
    w = least - k + 1
    suffixes = keep(sampled_positions(docs, k, w, spelled=True), "places")
    # sorted by their words; a suffix goes on if one of its neighbours begins with the same k words
    found = keep(segments(docs, sharing(suffixes, ["m"], [*KEY, "pos"]).select(*KEY, "pos"), k, w), "segments")
    discard(suffixes)
    flags = repeated_segments(keep(distinct_segments(found), "distinct")).withColumnsRenamed({"m": "_m", "s": "_s"})
    # a segment has one row for each row of docs; only the number of rows of a text is kept of that
    rows = found.groupBy(*KEY, "m", "s", "a").agg(F.count("*").alias("rows")).join(flags, (F.col("m") == F.col("_m")) & (F.col("s") == F.col("_s")))
    lists = rows.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("a", "mask", "copies"))).alias("parts"), F.min("rows").alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("copies", pa.int64())]))
        for batch in batches:
            out = [extend(parts, least) for parts in batch["parts"].to_pylist()]
            total = pa.array([sum(e - b for b, e, _ in x) for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["rows"], total, pa.array(out, kind)], names=["doc_id", "rows", "n_repeated", "passages"])

    out = lists.mapInArrow(run, "doc_id long, rows long, n_repeated long, passages array<struct<begin:int,end:int,copies:bigint>>")
    return out.withColumn("rows", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("rows")


def extend(parts: list[dict], least: int) -> list[tuple[int, int, int]]:
    """Passages of one text: repeated windows in order, joined where they meet."""
    out: list[list[int]] = []
    for p in parts:
        for begin, end in covered([(p["a"], p["mask"])], least):
            if out and out[-1][1] >= begin:
                out[-1][1] = end
                out[-1][2] = max(out[-1][2], p["copies"])
            else:
                out.append([begin, end, p["copies"]])
    return [tuple(x) for x in out]


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_repeated and passages (begin-end of each, by words) of the documents that have any."""
    found = repeated_passages(load(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("passages", lambda p: F.concat(p["begin"].cast("string"), F.lit("-"), p["end"].cast("string"))), " ")
    return found.select("doc_id", "n_repeated", spans.alias("passages"))


SQL = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT r, unnest(range(1, len(w) - 48)) AS i, w FROM t WHERE len(w) >= 50),
h AS (SELECT r, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM x),
d AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
s AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM h JOIN d USING (h)),
g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM s),
p AS (SELECT r, g, min(i) - 1 AS b, max(i) + 49 AS e FROM g GROUP BY r, g)
SELECT doc_id, CAST(sum(e - b) AS BIGINT) AS n_repeated, string_agg(b || '-' || e, ' ' ORDER BY b) AS passages FROM p JOIN t USING (r) GROUP BY r, doc_id
"""
