"""Mixing sources to target weights: fixed-length blocks of words, drawn per output shard through index permutations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, exact_rank, keep, load, mix, pieces, restored, text_bytes, words

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_WORDS = 128
SHARD_SLOTS = 1 << 14
#: Slots that are made at once, and output shards that one task makes.
RUN_SLOTS = 1 << 16
TASK_SHARDS = 4


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words; null text: 0) and a digest of the text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            _, _, first = words(*text_bytes(batch))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["source"], pa.array(np.diff(first)), batch["digest"]], names=["doc_id", "source", "size", "digest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text", F.xxhash64("text").alias("digest"))
    return rows.mapInArrow(run, "doc_id long, source string, size long, digest long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words to take of each source: `share` of all by weight, at most `most` times its size, the excess reshared."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), {}, list(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] >= most * sizes[s]]
        if not full:
            out |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def taken_by(good: int, pool: int, n: int, rng: np.random.Generator) -> int:
    """How many of n slots, drawn from a pool, are among its `good` ones: hypergeometric (beyond what numpy's draw
    takes, by the normal law of the same mean and variance, of which the share of rounding is then negligible)."""
    if pool < 10**9:
        return int(rng.hypergeometric(good, pool - good, n)) if n else 0
    p = good / pool
    x = round(n * p + rng.standard_normal() * np.sqrt(n * p * (1 - p) * (pool - n) / (pool - 1)))
    return max(0, n - (pool - good), min(good, n, x))


class Shards:
    """Slots of each source in each output shard: multinomial draws by weight, given that all quotas are used up.

    Such draws are those of shuffled slots without replacement. They are split between the halves of the shards, and
    again, so that any shard's counts follow from the quotas and a seed alone, in as many steps as halvings.
    """

    def __init__(self, quota: np.ndarray, shard_slots: int, seed: int):
        self.quota, self.slots, self.seed = [int(q) for q in quota], shard_slots, seed
        self.total = sum(self.quota)
        self.count = -(-self.total // shard_slots)
        self.known: dict[tuple[int, int], list[int]] = {}

    def left_half(self, quota: list[int], lo: int, mid: int, hi: int) -> list[int]:
        if (lo, hi) not in self.known:
            rng = np.random.Generator(np.random.PCG64([self.seed, lo, hi]))
            n, pool, out = min(mid * self.slots, self.total) - lo * self.slots, sum(quota), []
            for q in quota:
                out.append(taken_by(q, pool, n, rng))
                n, pool = n - out[-1], pool - q
            self.known[lo, hi] = out
        return self.known[lo, hi]

    def __getitem__(self, k: int) -> tuple[list[int], list[int]]:
        """For each source the slots in shard k, and those in the shards before it."""
        lo, hi, quota, before = 0, self.count, self.quota, [0] * len(self.quota)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            left = self.left_half(quota, lo, mid, hi)
            if k < mid:
                quota, hi = left, mid
            else:
                before = [b + x for b, x in zip(before, left)]
                quota, lo = [q - x for q, x in zip(quota, left)], mid
        return quota, before


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n), chosen by key, at i: Feistel rounds, walked until below n."""
    half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    x, todo = i.astype(np.uint64), np.arange(len(i))
    while len(todo):
        left, right = x[todo] >> half, x[todo] & mask
        for r in range(6):
            left, right = right, left ^ (mix(right + np.uint64((key * 8 + r) * 0x9E3779B97F4A7C15 % (1 << 64))) & mask)
        x[todo] = left << half | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def mix_plan(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: int = 2, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The slots of the mix and the segments of documents in its blocks.

    slots: shard, slot (place in the shard), sid (number of the source), pass_no (how often the block came before),
    block. segments: a row for each document and block that it reaches into (none for size 0): doc_id, source,
    digest, size, before (words of its source before it), sid, source_size, target, block, begin and end (words of
    the document in the block), and block null where the size is 0. Documents stand in their source in an order
    by hash. Only one row for each source comes to the driver; each task draws the slots of its shards by itself.
    """
    rows = keep(sized(documents), "sizes")
    spark = rows.sparkSession
    of = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).collect()
    totals = {r.source: r.n for r in of}
    order = sorted((s for s in totals if s is not None)) + [None] * (None in totals)
    goal = targets(totals, weights, share, most)
    blocks = np.array([-(-totals[s] // block_words) for s in order], np.int64)
    quota = np.array([min(most * b, round(goal[s] / totals[s] * b)) if b else 0 for s, b in zip(order, blocks.tolist())], np.int64)
    shards = Shards(quota, shard_slots, seed)

    def slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch["id"].to_pylist():
                place = 0
                for s, (count, before) in enumerate(zip(*shards[k])):
                    for o in range(0, count, RUN_SLOTS):
                        n = min(RUN_SLOTS, count - o)
                        again, i = np.divmod(np.arange(before + o, before + o + n), blocks[s])
                        block = np.empty(n, np.int64)
                        for e in np.unique(again).tolist():
                            block[again == e] = permuted(i[again == e], int(blocks[s]), (seed * 1000003 + s) * 64 + e)
                        one = np.ones(n, np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one * k, place + o + np.arange(n), one * s, again, block)], names=["shard", "slot", "sid", "pass_no", "block"])
                    place += count

    planned = spark.range(0, shards.count, 1, max(1, -(-shards.count // TASK_SHARDS)))
    slots = planned.mapInArrow(slots_of, "shard long, slot long, sid long, pass_no long, block long")
    named = spark.createDataFrame([(i, s, totals[s], float(goal[s])) for i, s in enumerate(order)], "sid long, name string, source_size long, target double")
    placed = rows.join(named, rows["source"].eqNullSafe(named["name"])).drop("name")
    placed = exact_rank(placed, ["sid"], [F.col("doc_id"), F.col("digest")], F.struct("doc_id", "digest"), F.col("size"), rows=sum(r.docs for r in of))
    last = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("before") / block_words), F.floor((F.col("before") + F.col("size") - 1) / block_words)))
    segments = placed.withColumn("block", F.explode_outer(last))
    start = F.greatest(F.col("block") * block_words - F.col("before"), F.lit(0))
    end = F.least((F.col("block") + 1) * block_words - F.col("before"), F.col("size"))
    return slots, segments.withColumns({"begin": F.when(F.col("block").isNotNull(), start), "end": F.when(F.col("block").isNotNull(), end)})


def taken_words(documents: DataFrame, **options) -> DataFrame:
    """doc_id, size, source, source_size, target, taken for every row of documents: the words that the mix takes."""
    slots, segments = mix_plan(documents, **options)
    uses = slots.groupBy("sid", "block").agg(F.count("*").alias("uses"))
    of = segments.join(uses.hint("merge"), ["sid", "block"], "left")
    row = ["doc_id", "digest", "sid", "source", "before", "size", "source_size", "target"]
    # equal rows of size 0 share all of these columns: count() brings each of them back
    of = of.groupBy(*row).agg(F.sum(F.coalesce((F.col("end") - F.col("begin")) * F.col("uses"), F.lit(0))).alias("taken"), F.sum(F.when(F.col("size") == 0, 1).otherwise(0)).alias("_n"))
    of = of.withColumn("_n", F.explode(F.sequence(F.lit(1), F.greatest(F.col("_n"), F.lit(1)))))
    return of.select("doc_id", "size", "source", "source_size", "target", "taken")


def mix_documents(documents: DataFrame, **options) -> DataFrame:
    """The rows of documents as the mix takes them, with all columns: text has the words taken, n_chars their length.

    A row stands once for each pass that takes any of its words, with these words in order, joined by one space
    where parts are left out between them. Rows that the mix takes nothing of, and rows without words, go. Other
    columns stay as they are, whatever their names.
    """
    slots, segments = mix_plan(documents, **options)
    used = segments.join(slots.select("sid", "block", "pass_no").hint("merge"), ["sid", "block"])
    spans = used.groupBy("doc_id", "source", "digest", "before", "pass_no").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    # equal rows (same id, source and text) are numbered, so that each meets its own place in the source
    from pyspark.sql import Window as W

    by_text = ["doc_id", "source", "digest"]
    place = segments.where("size > 0").select(*by_text, "before").distinct().withColumn("_k", F.row_number().over(W.partitionBy(*by_text).orderBy("before"))).withColumnRenamed("before", "_at")
    spans = spans.join(place, [spans[c].eqNullSafe(place[c]) for c in by_text] + [spans["before"] == place["_at"]]).select(*(spans[c] for c in by_text), "_k", "pass_no", "spans")
    spans = spans.select(*(F.col(c).alias(f"_{c}") for c in by_text), F.col("_k").alias("_k2"), "pass_no", "spans")
    docs = aside(documents, "doc_id", "source", "text").withColumns({"_id": F.col("doc_id").cast("long"), "_d": F.xxhash64("text")})
    docs = docs.withColumn("_k", F.row_number().over(W.partitionBy("_id", "source", "_d").orderBy("_d")))
    joined = docs.join(spans, docs["_id"].eqNullSafe(spans["_doc_id"]) & docs["source"].eqNullSafe(spans["_source"]) & (docs["_d"] == spans["_digest"]) & (docs["_k"] == spans["_k2"]))
    joined = joined.select(*(docs[c] for c in ("doc_id", "source", "text", "_rest")), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offsets = text_bytes(batch)
            starts, ends, first = words(data, offsets)
            out = []
            for f, spans_ in zip(first.tolist(), batch["spans"].to_pylist()):
                merged: list[list[int]] = []
                for s in spans_:
                    if merged and merged[-1][1] == s["begin"]:
                        merged[-1][1] = s["end"]
                    else:
                        merged.append([s["begin"], s["end"]])
                out.append(b" ".join(data[starts[f + a] : ends[f + b - 1]] for a, b in merged).decode())
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns) if n != "spans"} | {"text": pa.array(out, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    out = joined.mapInArrow(cut, T.StructType(joined.drop("spans").schema.fields))
    size = {"n_chars": F.length("text").cast(documents.schema["n_chars"].dataType)} if "n_chars" in documents.columns else {}
    return restored(out, documents.columns, "doc_id", "source", "text", **size)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(load(spark, sf_dir, "documents"))
