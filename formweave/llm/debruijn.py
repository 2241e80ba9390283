"""Substring dedup over a De Bruijn graph: windows of words are edges, repeated unbranched paths are compacted by joins."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, keep, load, pieces, text_bytes, tidy, words
from .repeats import KEY, covered, distinct_segments, known, repeated_segments, sampled_positions, segments, sharing

WINDOW_WORDS = 35
RUN_WORDS = 12


def repeated_paths(docs: DataFrame, window: int = WINDOW_WORDS, k: int = RUN_WORDS) -> DataFrame:
    """doc_id, digest and paths of each distinct row of docs with repeated windows.

    paths: array of struct(begin, end, path, copies): words begin .. end - 1 are covered by repeated windows that
    follow each other along one path of the graph; path is the name of its first segment.

    The graph's edges are the windows, its nodes what successive windows share. Only windows whose minimiser occurs
    twice can repeat. Successive ones of one minimiser are a segment, a chain of edges that is known by a digest of
    its words. Segments that always come together are compacted into paths by joins; a path's places follow from the
    places of its segments in the texts, which must adjoin there.
    """
    w = window - k + 1
    places = keep(sampled_positions(docs, k, w), "places")
    candidates = sharing(places, ["m"], [*KEY, "pos"]).select(*KEY, "pos")
    found = keep(segments(docs, candidates, k, w), "segments")
    discard(places)
    per = keep(distinct_segments(found), "distinct")
    flags = keep(repeated_segments(per).join(compacted(per), ["m", "s"], "left"), "flags").withColumnsRenamed({"m": "_m", "s": "_s"})
    rows = found.select(*KEY, "m", "s", "name", "a", "n").distinct().join(flags, (F.col("m") == F.col("_m")) & (F.col("s") == F.col("_s")))
    # a path's segments stand one after the other in every text that has it
    begin = (F.col("a") - F.coalesce("at", F.lit(0))).alias("begin")
    spans = rows.groupBy(*KEY, F.coalesce("head", "name").alias("path"), begin).agg(
        F.min("a").alias("first"), F.max(F.col("a") + F.col("n")).alias("last"), F.sum("n").alias("windows"), F.max("mask").alias("mask"), F.min("copies").alias("copies"),
    )
    fits = (F.col("first") == F.col("begin")) & (F.col("last") - F.col("first") == F.col("windows"))
    spans = spans.withColumn("last", F.when(fits, F.col("last")).otherwise(F.raise_error(F.lit("a path does not adjoin in a text")).cast("int")))
    whole = F.col("copies") > 1
    each = F.struct("begin", (F.col("last") + window - 1).alias("end"), F.hex("path").alias("path"), "copies", F.when(~whole, F.col("mask")).alias("mask"))
    lists = spans.groupBy(*KEY).agg(F.sort_array(F.collect_list(each)).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("path", pa.string()), ("copies", pa.int64())]))
        for batch in batches:
            out = []
            for parts in batch["parts"].to_pylist():
                out.append([(b, e, p["path"], p["copies"]) for p in parts for b, e in ([(p["begin"], p["end"])] if p["mask"] is None else covered([(p["begin"], p["mask"])], window))])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["digest"], pa.array(out, kind)], names=[*KEY, "paths"])

    return lists.mapInArrow(run, "doc_id long, digest long, paths array<struct<begin:int,end:int,path:string,copies:bigint>>")


def compacted(per: DataFrame) -> DataFrame:
    """m, s, head and at of the repeated segments that go on a path: its first segment, and the windows before.

    Two segments are joined if every copy of one is followed by the other, and every copy of that comes after it.
    Such a chain has a beginning, as every text has. Its segments find it by pointer doubling: in each round every
    segment joins the one it points to and takes over what that points to.
    """
    many = per.where("copies > 1")
    after = many.where("_after is not null").select(F.col("name").alias("head"), F.col("_after").alias("name"), F.col("n").alias("at"))
    links = many.where("_before is not null").select("m", "s", "name", F.col("_before").alias("head")).join(after, ["name", "head"])
    now = keep(links.select("m", "s", "name", "head", F.col("at").cast("long").alias("at")), "paths")
    while True:
        to = now.select(F.col("name").alias("_name"), F.col("head").alias("_head"), F.col("at").alias("_at"))
        joined = now.join(to, F.col("head") == F.col("_name"), "left")
        moved = F.col("_name").isNotNull()
        nxt = keep(joined.select("m", "s", "name", F.coalesce("_head", "head").alias("head"), (F.col("at") + F.coalesce("_at", F.lit(0))).alias("at"), moved.alias("moved")), "paths")
        discard(now)
        now = nxt.drop("moved")
        now._kept_at = nxt._kept_at
        if nxt.where("moved").isEmpty():
            return now.select("m", "s", "head", "at")


def remove_repeats(docs: DataFrame, window: int = WINDOW_WORDS, k: int = RUN_WORDS, keep_text: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256 (and kept_text on request).

    A word goes if a window of `window` words that holds it also starts anywhere else, in the same text or another.
    Words are what spaces and control characters 9 to 13 leave; a null text has none. Null ids and repeated rows are
    rows like others: equal texts remove each other from `window` words on.
    """
    docs = docs.select("doc_id", "text")
    paths = keep(repeated_paths(docs, window, k), "paths")
    left = known(docs)
    both = left.join(paths, left["doc_id"].eqNullSafe(paths["doc_id"]) & (left["digest"] == paths["digest"]), "left")
    both = both.select(left["doc_id"], "text", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offsets = tidy(*text_bytes(batch))
            starts, ends, first = words(data, offsets)
            removed, digests, texts = [], [], []
            for b, e, paths_ in zip(first[:-1].tolist(), first[1:].tolist(), batch["paths"].to_pylist()):
                n = e - b
                if not paths_:
                    text = data[starts[b] : ends[e - 1]] if n else b""
                    removed.append(0)
                else:
                    edge = np.zeros(n + 1, np.int64)
                    for p in paths_:
                        edge[p["begin"]] += 1
                        edge[p["end"]] -= 1
                    gone = np.cumsum(edge)[:n] > 0
                    change = np.flatnonzero(np.diff(np.concatenate(([1], gone.astype(np.int8), [1]))))
                    text = b" ".join(data[starts[b + x] : ends[b + y - 1]] for x, y in zip(change[::2].tolist(), change[1::2].tolist()))
                    removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(text).hexdigest())
                texts.append(text.decode() if keep_text else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(first)), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    fields = [("doc_id", T.LongType()), ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()), ("kept_text", T.StringType())]
    out = both.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in fields]))
    return out if keep_text else out.drop("kept_text")


def op2_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents"))


SQL = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM t WHERE len(w) >= 35),
h AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM x),
d AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
s AS (SELECT r, list(DISTINCT i + o ORDER BY i + o) AS gone FROM (SELECT r, i, unnest(range(0, 35)) AS o FROM h JOIN d USING (h)) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]), ' ') END) AS kept_sha256
FROM t LEFT JOIN s USING (r)
"""
