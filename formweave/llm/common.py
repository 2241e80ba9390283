"""Helpers that the corpus operators share: tables in the shared folder, Arrow batches, words, exact ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of text that a kernel handles at once; a longer text makes a piece of its own.
PIECE_BYTES = 1 << 21
#: Words are maximal runs of bytes other than these.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_SEPARATOR = np.isin(np.arange(256), np.frombuffer(SEPARATORS, np.uint8))
TO_SPACE = bytes(32 if c in SEPARATORS else c for c in range(256))
LOWER_TO_SPACE = bytes(32 if c in SEPARATORS else c + 32 if 65 <= c <= 90 else c for c in range(256))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session without it gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="formweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: short lineage that survives lost executors.

    The shuffle files of its making go at once, not when the driver happens to collect its garbage.
    """
    spark, option = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(option, None)
    spark.conf.set(option, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(option) if before is None else spark.conf.set(option, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of keep() that nothing will read any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def texts_only(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) with the named columns, whatever else docs has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def aside(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all others in one struct `_rest`: no extra column clashes with one of an operator's own."""
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in names]
    return docs.select(*names, F.struct(F.lit(0).alias("none"), *others).alias("_rest"))


def restored(df: DataFrame, columns: list[str], *names: str, **replaced: Column) -> DataFrame:
    """`columns` of the docs given to aside(docs, *names), but for those replaced."""
    where = {c: F.col(c) if c in names else F.col(f"_rest.c{i}") for i, c in enumerate(columns)} | replaced
    return df.select(*(where[c].alias(c) for c in columns))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, cut into batches of about `limit` bytes of `column`."""
    for batch in batches:
        if batch.num_rows:
            ends = np.cumsum(np.frombuffer(pc.fill_null(pc.binary_length(batch[column]), 0).cast(pa.int64()).buffers()[1], np.int64, batch.num_rows))
            at = 0
            while at < batch.num_rows:
                done = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
                yield batch.slice(at, to - at)
                at = to


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> tuple[bytes, np.ndarray]:
    """All texts as one bytes object, and the offsets of each."""
    values = batch[column].cast(pa.large_binary())
    if values.null_count:
        values = pc.fill_null(values, b"")
    start = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
    body = values.buffers()[2]
    return (body[int(start[0]) : int(start[-1])].to_pybytes() if body else b""), start - start[0]


def longs(batch: pa.RecordBatch, column: str = "doc_id") -> np.ndarray:
    return np.asarray(pc.fill_null(batch[column].cast(pa.int64()), 0))


def words(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of words before it (one more at the end)."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    np.logical_not(IS_SEPARATOR[raw], out=inside[1:-1])
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = offsets[(offsets > 0) & (offsets < len(raw))]
    begins[edge] = inside[edge + 1]
    ends[edge - 1] = inside[edge]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def tidy(data: bytes, offsets: np.ndarray, lower: bool = False) -> tuple[bytes, np.ndarray]:
    """The same words with one space between them (a text may still begin or end with one)."""
    raw = np.frombuffer(data.translate(LOWER_TO_SPACE if lower else TO_SPACE), np.uint8)
    space = raw == 32
    again = np.zeros(len(raw), bool)
    again[1:] = space[1:] & space[:-1]
    again[offsets[:-1][offsets[:-1] < len(raw)]] = False
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(~again, out=before[1:])
    return raw[~again].tobytes(), before[offsets]


_RANDOM = np.random.Generator(np.random.PCG64(20260101))
BYTE_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_RANDOM.integers(1, 1 << 62)) * 4 + 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the values from each start to its end, the same wherever they stand."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(values) + 1)[starts])


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, alike in every task."""
    return run_sums(BYTE_VALUES[np.frombuffer(data, np.uint8)], starts, ends)


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n successive values of h."""
    count = len(h) - n + 1
    out = np.zeros(max(0, count), np.uint64)
    if count > 0:
        for j, p in enumerate(powers(BASE, n)):
            out += h[j : j + count] * p
    return mix(out)


def ragged(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """firsts[i], firsts[i] + 1, ... (counts[i] values) for each i in turn."""
    total = int(counts.sum())
    out = np.ones(total, np.int64)
    if total:
        some = counts > 0
        f, c = firsts[some], counts[some]
        at = np.cumsum(c) - c
        out[at] = f - np.concatenate(([0], f[:-1] + c[:-1] - 1))
        np.cumsum(out, out=out)
    return out


def exact_rank(df: DataFrame, group: list[str], order: list[Column], salt: Column, amount: Column | None = None, name: str = "before", rows: int = 0) -> DataFrame:
    """Adds the sum of `amount` (1 each by default) over the rows of the same group that come earlier.

    Rows come in the order of (bucket, order), where a bucket is a hash of `salt`: a hot group is summed
    in many tasks, and only one row for each group and bucket meets in one place. There are as many buckets as
    `rows` needs (512 at least) for one of them to hold a million rows of a group that has them all.
    """
    buckets = max(512, rows >> 20)
    amount = F.lit(1).cast("long") if amount is None else amount
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(salt), F.lit(buckets)).cast("int")).withColumn("_amount", amount)
    sums = df.groupBy(*group, "_bucket").agg(F.sum("_amount").alias("_sum"))
    sums = sums.withColumn("_base", F.sum("_sum").over(W.partitionBy(*group).orderBy("_bucket")) - F.col("_sum")).drop("_sum")
    inside = W.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    df = df.withColumn("_upto", F.sum("_amount").over(inside))
    same = [df[c].eqNullSafe(sums[c]) for c in (*group, "_bucket")]
    out = df.join(sums, reduce(lambda a, b: a & b, same))
    return out.select(*(df[c] for c in df.columns if c[0] != "_"), (F.col("_base") + F.col("_upto") - F.col("_amount")).alias(name))
