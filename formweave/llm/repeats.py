"""Repeated word windows, found from content-selected positions: what both substring operators share.

A window of k + w - 1 words holds w runs of k words; the run with the smallest hash (the first of these) is its
minimiser. Equal windows have equal minimisers at equal places, so a window can only repeat if its minimiser does.
Successive windows of a text with one minimiser are a segment, which stands for its windows as long as they are alike
everywhere. A text is known by its doc_id and a hash of it; rows alike in both are handled alike and count apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, pieces, ragged, run_hashes, text_bytes, tidy, word_hashes, words

KEY = ["doc_id", "digest"]


def known(docs: DataFrame) -> DataFrame:
    """doc_id, digest and text (null: empty) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))


def first_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """For each w successive values the place of the first smallest."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    value, place, size = x, np.arange(len(x)), 1
    while size < w:
        step = min(size, w - size)
        right = value[step:] < value[:-step]
        place = np.where(right, place[step:], place[:-step])
        value = x[place]
        size += step
    return place


def minimisers(data: bytes, offsets: np.ndarray, k: int, w: int):
    """Of tidy texts: word starts, ends and firsts, hashes of words, and for each window that lies in one text the
    text, the window's first word and its minimiser (word numbers over all texts), and the hash of that."""
    starts, ends, first = words(data, offsets)
    h = word_hashes(data, starts, ends)
    runs = run_hashes(h, k)
    place = first_minimum(runs, w)
    text = np.repeat(np.arange(len(first) - 1), np.maximum(np.diff(first) - (k + w - 2), 0))
    window = ragged(first[:-1], np.maximum(np.diff(first) - (k + w - 2), 0))
    place = place[window]
    return starts, ends, first, h, text, window, place, runs[place]


def sampled_positions(docs: DataFrame, k: int, w: int, spelled: bool = False) -> DataFrame:
    """m (hash of k words, or these words themselves), doc_id, digest, pos (number of the first of them) at each
    minimiser of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offsets = tidy(*text_bytes(batch))
            starts, ends, first, _, text, _, place, m = minimisers(data, offsets, k, w)
            new = np.ones(len(place), bool)
            new[1:] = place[1:] != place[:-1]
            text, place, m = text[new], place[new], m[new]
            of = pa.array(text)
            own = pa.array([data[s:e] for s, e in zip(starts[place].tolist(), ends[place + k - 1].tolist())], pa.binary()) if spelled else pa.array(m.view(np.int64))
            yield pa.RecordBatch.from_arrays([own, batch["doc_id"].take(of), batch["digest"].take(of), pa.array((place - first[text]).astype(np.int32))], names=["m", *KEY, "pos"])

    return known(docs).mapInArrow(run, f"m {'binary' if spelled else 'long'}, doc_id long, digest long, pos int")


def sharing(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The rows of which another row has the same key, whatever share of all rows one key has.

    Rows are range-partitioned and sorted by key and order, so a frequent key fills as many partitions as it needs;
    a row is compared with the rows next to it, and those at the edges of partitions are settled among themselves.
    """
    names = rows.columns
    ordered = rows.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)

    def judge(table: pa.Table, begin: int, end: int, first: bool, last: bool) -> pa.RecordBatch:
        """Rows begin .. end - 1 that match a row next to them, or have their neighbour in another partition."""
        same = np.ones(table.num_rows - 1, bool)
        for c in key:
            x = table[c].combine_chunks()
            same &= np.asarray(pc.equal(x[1:], x[:-1]))
        sure, edge = np.concatenate(([False], same)) | np.concatenate((same, [False])), np.zeros(table.num_rows, bool)
        edge[0], edge[-1] = first, last
        pick = begin + np.flatnonzero((sure | edge)[begin:end])
        found = table.take(pa.array(pick))
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in found.columns]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks else c for c in columns]
        return pa.RecordBatch.from_arrays([*columns, pa.array(edge[pick]), pa.array(sure[pick])], names=[*names, "_edge", "_sure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True  # the last row waits for its right neighbour, beside the one before it
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            if held.num_rows > 2:
                cut = held.num_rows - 1
                yield judge(held, 0 if first else 1, cut, first, False)
                held, first = held.slice(cut - 1), False
        if held is not None and held.num_rows:
            yield judge(held, 0 if first else 1, held.num_rows, first, True)

    judged = keep(ordered.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_edge", T.BooleanType()), T.StructField("_sure", T.BooleanType())])), "sharing")
    edges = judged.where("_edge").groupBy(*key).agg(F.count("*").alias("_c")).where("_c > 1").drop("_c")
    rest = judged.where("_edge and not _sure").join(edges, key).select(*judged.columns)
    return judged.where("_sure").unionByName(rest).select(*names)


def segments(docs: DataFrame, candidates: DataFrame, k: int, w: int) -> DataFrame:
    """The segments at the candidate positions (doc_id, digest, pos): one row for each row of docs that has them.

    doc_id, digest, m, s (digest of the segment's words), name (its first 8 bytes), a (its first word), n (number of
    windows), windows (8 bytes for each window's hash), before and after (name of the candidate segment that adjoins,
    or null).
    """
    at = candidates.groupBy(*KEY).agg(F.collect_set("pos").alias("at"))
    docs = known(docs)
    joined = docs.join(at, docs["doc_id"].eqNullSafe(at["doc_id"]) & (docs["digest"] == at["digest"])).select(docs["doc_id"], docs["digest"], "text", "at")
    span = k + w - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=1 << 20):
            data, offsets = tidy(*text_bytes(batch))
            starts, ends, first, h, text, window, place, m = minimisers(data, offsets, k, w)
            lists = batch["at"]
            of = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            wanted = np.zeros(len(starts) + 1, bool)
            wanted[np.asarray(lists.flatten()) + first[of]] = True
            use = wanted[place]
            text, window, place, m = text[use], window[use], place[use], m[use]
            code = run_hashes(h, span)[window] if len(window) else h[:0]
            cut = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, np.int64)
            size = np.diff(np.append(cut, len(place)))
            a, m, text = window[cut], m[cut], text[cut]
            s = [hashlib.blake2b(data[x:y], digest_size=16).digest() for x, y in zip(starts[a].tolist(), ends[a + size + span - 2].tolist())]
            short = np.array([int.from_bytes(x[:8], "little", signed=True) for x in s], np.int64)
            joins = (text[1:] == text[:-1]) & (a[1:] == a[:-1] + size[:-1]) if len(a) else np.zeros(0, bool)
            raw = code.astype("<u8").tobytes()
            codes = [raw[8 * c : 8 * (c + n)] for c, n in zip(cut.tolist(), size.tolist())]
            row = pa.array(text)
            none = np.ones(1, bool)[: len(a)]
            before = pa.array(np.roll(short, 1), mask=np.concatenate((none, ~joins)))
            after = pa.array(np.roll(short, -1), mask=np.concatenate((~joins, none)))
            columns = [batch["doc_id"].take(row), batch["digest"].take(row), pa.array(m.view(np.int64)), pa.array(s, pa.binary()), pa.array(short), pa.array((a - first[text]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(codes, pa.binary()), before, after]
            yield pa.RecordBatch.from_arrays(columns, names=[*KEY, "m", "s", "name", "a", "n", "windows", "before", "after"])

    return joined.mapInArrow(run, "doc_id long, digest long, m long, s binary, name long, a int, n int, windows binary, before long, after long")


def distinct_segments(found: DataFrame) -> DataFrame:
    """m, s, n, name, windows, copies, and _before / _after: the segment that adjoins all copies, or null."""
    same = lambda c: F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c))
    return found.groupBy("m", "s", "n").agg(F.count("*").alias("copies"), F.first("name").alias("name"), F.first("windows").alias("windows"), same("before").alias("_before"), same("after").alias("_after"))


def repeated_segments(per: DataFrame, salts: int = 16) -> DataFrame:
    """m, s and mask (bit i: window i of the segment also starts elsewhere) for each distinct segment with such a window.

    A segment that occurs twice repeats all its windows. Windows are only compared one by one where a segment that
    occurs once shares its minimiser with others; each distinct segment is then taken once with its copies. A
    minimiser with very many different segments is dealt to several tasks.
    """
    mixed = per.groupBy("m").agg(F.min("copies").alias("least"), F.count("*").alias("kinds")).where("least = 1 and kinds > 1")
    mixed = mixed.select(F.col("m").alias("_m"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_t"))
    some = per.withColumn("_salt", F.pmod(F.xxhash64("s"), F.lit(salts)).cast("int")).join(mixed, (F.col("m") == F.col("_m")) & (F.col("_salt") == F.col("_t")))
    ones = some.select("m", "s", "copies", "windows", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    ones = ones.select("m", "s", "copies", "i", F.expr("substring(windows, 8 * i + 1, 8)").alias("code"))
    # equal windows have equal minimisers, so the count is by both
    again = ones.groupBy("m", "code").agg(F.sum("copies").alias("all")).where("all > 1")
    once = ones.where("copies = 1").join(again, ["m", "code"])
    masks = once.groupBy("s").agg(F.expr("bit_or(shiftleft(1L, i))").alias("mask")).withColumnRenamed("s", "_s")
    out = per.join(masks, F.col("s") == F.col("_s"), "left")
    out = out.withColumn("mask", F.when(F.col("copies") > 1, F.expr("shiftleft(1L, n) - 1")).otherwise(F.col("mask"))).where("mask is not null")
    return out.select("m", "s", "mask", "copies")


def covered(parts: list[tuple[int, int]], window: int) -> Iterator[tuple[int, int]]:
    """Words (begin, end) under the windows that each (first word, mask of windows) has, run by run."""
    for at, mask in parts:
        while mask:
            skip = (mask & -mask).bit_length() - 1
            mask, at = mask >> skip, at + skip
            run = (~mask & (mask + 1)).bit_length() - 1
            yield at, at + run + window - 1
            mask, at = mask >> run, at + run
