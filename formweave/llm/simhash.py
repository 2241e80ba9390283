"""SimHash near-duplicates: 64-bit fingerprints linked at a small Hamming distance by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, keep, load, longs, pieces, ragged, restored, text_bytes, texts_only, tidy, words
from .components import connected_components, forest, in_groups

#: Nodes of classes whose doc_ids are all null lie above this; they name no component.
NO_ID = (1 << 63) - (1 << 45)
#: Fingerprints that share a key with one by chance, and tasks that the rows of a frequent fingerprint are dealt to.
CHANCE, SALTS = 8, 8


def shingle_hashes(data: bytes, offsets: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the word shingles of each text, text by text, and how many each text has."""
    data, offsets = tidy(data, offsets, lower=True)
    starts, ends, first = words(data, offsets)
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    at = ragged(first[:-1], count)
    last = np.minimum(at + size, np.repeat(first[1:], count)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[s:e], seed) for s, e in zip(starts[at].tolist(), ends[last].tolist())), np.uint64, len(at))
    return hashes, count


def majority_bits(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each text the bits set in over half of its hashes (no hashes: zero)."""
    out = np.zeros((len(count), 64), np.int64)
    some = np.flatnonzero(count)
    if len(some):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = np.cumsum(count[some]) - count[some]
        for i, s, e in zip(some, at, at + count[some]):
            out[i] = bits[s:e].sum(axis=0, dtype=np.int32)
    set_ = (2 * out > count[:, None]).astype(np.uint8)
    return np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, size: int = 4, seed: int = 42, *more: str) -> DataFrame:
    """(doc_id long, fp long, and the long columns named) of every row: SimHash over lower-cased (A-Z) word shingles, repeats included.

    Null, empty and blank texts have the fingerprint zero; fewer words than `size` make one shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=1 << 20):
            fp = majority_bits(*shingle_hashes(*text_bytes(batch), size, seed))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fp.view(np.int64)), *(batch[c] for c in more)], names=["doc_id", "fp", *more])

    return texts_only(docs, *more).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *more)))


def block_keys(fp, blocks: int, equal: int) -> list:
    """For each choice of `equal` of the blocks, its number and the bits of fp in these blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    out = []
    for k, chosen in enumerate(combinations(range(blocks), equal)):
        mask = sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in chosen)
        out.append(F.struct(F.lit(k).alias("t"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("key")))
    return out


def close_pairs(distance: int):
    """A spanning forest of the links (at most `distance` differing bits) in each group of (fp, node)."""

    def compare(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(bounds) < 2:
            return
        fp, node = np.asarray(table["fp"]).view(np.uint64), np.asarray(table["node"])
        cross, left = np.asarray(table["_i"]) != np.asarray(table["_j"]), np.asarray(table["_left"])
        sizes = np.diff(bounds)
        a, b = [], []
        small = (sizes <= 24) & ~cross[bounds[:-1]]
        group = np.repeat(np.arange(len(sizes)), sizes)
        for d in range(1, int(sizes[small].max(initial=1))):
            i = np.flatnonzero((group[d:] == group[:-d]) & small[group[d:]])
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= distance]
            a.append(node[i])
            b.append(node[i + d])
        for s, e in zip(bounds[:-1][~small], bounds[1:][~small]):
            near = np.bitwise_count(fp[s:e, None] ^ fp[None, s:e]) <= distance
            if cross[s]:
                near &= left[s:e, None] != left[None, s:e]
            root = forest(near)
            a.append(node[s:e])
            b.append(node[s:e][root])
        a, b = np.concatenate(a or [node[:0]]), np.concatenate(b or [node[:0]])
        yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    return compare


def enough_blocks(count: int, distance: int) -> int:
    """Blocks so that a fingerprint shares a key with few others by chance: more of them make longer keys, for more rows."""
    blocks = distance + 2
    while count / 2 ** (64 * (blocks - distance) / blocks) > CHANCE and blocks < 16:
        blocks += 1
    return blocks


def near_groups(prints: DataFrame, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """prints (doc_id, fp and more) with component_id, the smallest doc_id that links reach, and the group's number.

    Fingerprints within `distance` bits agree on at least blocks - distance of the blocks, so that each choice
    of that many blocks is a join key that together find every link. Their number follows from that of different
    fingerprints. Equal fingerprints are one node; a frequent one meets its rows in several tasks. Rows whose doc_id
    is null get a component but never name one.
    """
    classes = keep(prints.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID) + F.pmod(F.xxhash64("fp"), F.lit(1 << 44))).alias("node")), "classes")
    blocks = blocks or enough_blocks(classes.count(), distance)
    if blocks <= distance:
        raise ValueError("blocks must exceed distance")
    keyed = classes.select("fp", "node", F.explode(F.array(*block_keys(F.col("fp"), blocks, blocks - distance))).alias("x")).select("x.t", "x.key", "fp", "node")
    links = in_groups(keyed, ["t", "key"], close_pairs(distance), "a long, b long")
    found = connected_components(links).withColumnRenamed("node", "n")
    named = classes.join(found, F.col("node") == F.col("n"), "left").select("fp", F.coalesce("component", "node").alias("group"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    rows = prints.withColumn("_salt", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(SALTS)).cast("int"))
    return rows.join(named, ["fp", "_salt"]).withColumn("component_id", F.when(F.col("group") < NO_ID, F.col("group"))).select(*prints.columns, "component_id", "group")


def one_of_each(docs: DataFrame, size: int = 4, seed: int = 42, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """docs with one row of each group of near-duplicates: that with the smallest doc_id (null ids last).

    All columns of docs come back as they are, whatever their names.
    """
    boxed = aside(docs, "doc_id", "text").withColumn("_digest", F.xxhash64("text"))
    prints = keep(fingerprints(boxed, size, seed, "_digest"), "fingerprints")
    return first_of_groups(docs, boxed, near_groups(prints, distance, blocks))


def first_of_groups(docs: DataFrame, boxed: DataFrame, grouped: DataFrame) -> DataFrame:
    """The row of docs with the smallest doc_id in each group of grouped (doc_id, _digest, group); boxed: docs set aside, with _digest."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("_digest").alias("digest"))
    chosen = grouped.groupBy("group").agg(F.min(first).alias("x")).select(F.coalesce("x.doc_id", F.lit(0)).alias("_id"), F.col("x.none").alias("_none"), F.col("x.digest").alias("_digest"))
    # joined and ranked by the same columns: texts are shuffled once
    same = ["_id", "_none", "_digest"]
    kept = boxed.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_none": F.col("doc_id").cast("long").isNull()}).join(chosen, same)
    # rows alike in id and text are one group: the first of them by their other columns stays
    from pyspark.sql import Window as W

    others = [F.col(f"_rest.c{i}") for i, (c, t) in enumerate(docs.dtypes) if c not in ("doc_id", "text") and "map<" not in t and "variant" not in t]
    order = W.partitionBy(*same).orderBy("doc_id", *others)
    return restored(kept.withColumn("_n", F.row_number().over(order)).where("_n = 1"), docs.columns, "doc_id", "text")


def simhash_near_dedup(docs: DataFrame, size: int = 4, seed: int = 42, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prints = keep(fingerprints(docs, size, seed), "fingerprints")
    return near_groups(prints, distance, blocks).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(load(spark, sf_dir, "documents"))
