"""Phrases whose words belong together: frequent n-grams by hashed bucket counts and Apriori pruning, scored at their weakest cut.

Pass k over the texts counts k-grams exactly, but only those that can be frequent: their bucket in the counts of the
pass before was, and both (k-1)-grams inside them are. The same pass counts buckets of the (k+1)-grams whose two
k-grams it counted. Bitmaps of buckets go to the tasks; they have MOST_BUCKETS bits at most, and only ever let too much
through, so the counts are exact whatever their size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import BASE, LOWER_TO_SPACE, discard, keep, load, mix, pieces, powers, text_bytes, word_hashes

LEAST_COUNT, LONGEST, BEST, INSIDE = 30, 4, 2000, 80
UNKNOWN = "und"
#: One bucket for so many bytes of text, within these bounds.
BYTES_PER_BUCKET, FEWEST_BUCKETS, MOST_BUCKETS = 128, 1 << 16, 1 << 27
#: Buckets in one row of counts.
SPAN = 1 << 12
#: Bytes of text that are counted at once.
CHUNK = 1 << 22
ENDS = np.isin(np.arange(256), np.frombuffer(b".,;:!?\x0a\x0b\x0c\x0d", np.uint8))
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLANK_OR_END = ENDS | np.isin(np.arange(256), np.frombuffer(b" \t", np.uint8))
RAW = "span int, buckets binary, lang string, gram string, n long"


@dataclass
class Words:
    """The words of some texts: number of each in `stock`, its piece, its language, and hashes of stock and languages."""

    ids: np.ndarray
    piece: np.ndarray
    lang: np.ndarray
    stock: pa.Array
    langs: list[str]
    hashes: np.ndarray
    salts: np.ndarray

    def grams(self, k: int) -> np.ndarray:
        """A hash of the k words from each one on, of their language, wherever they stand; only those in one piece count."""
        n = max(0, len(self.ids) - k + 1)
        h = self.salts[self.lang[:n]].copy()
        for j, p in enumerate(powers(BASE, k)):
            h += self.hashes[self.ids[j : j + n]] * p
        return mix(h)

    def together(self, k: int) -> np.ndarray:
        """Whether the k words from each one on stand in one piece."""
        n = max(0, len(self.ids) - k + 1)
        return self.piece[:n] == self.piece[k - 1 : k - 1 + n]

    def counted(self, at: np.ndarray, k: int) -> pa.RecordBatch:
        """lang, gram, n of the different k-grams that begin at these words, told apart by their words."""
        code, d = self.lang[at] * len(self.stock) + self.ids[at], len(self.stock)
        for j in range(1, k):
            code = np.unique(code, return_inverse=True)[1] * d + self.ids[at + j]
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        at = at[first]
        gram = pc.binary_join_element_wise(*(self.stock.take(pa.array(self.ids[at + j])) for j in range(k)), pa.scalar(b" ", pa.large_binary()))
        langs = pa.array(self.langs, pa.string()).take(pa.array(self.lang[at]))
        return rows(len(at), lang=langs, gram=gram.cast(pa.large_string()).cast(pa.string()), n=pa.array(n, pa.int64()))


def rows(count: int, **given: pa.Array) -> pa.RecordBatch:
    kinds = {"span": pa.int32(), "buckets": pa.binary(), "lang": pa.string(), "gram": pa.string(), "n": pa.int64()}
    return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(count, t)) for c, t in kinds.items()], names=list(kinds))


def salts_of(langs: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in langs], np.uint64)


def hashes_of(stock: pa.Array) -> np.ndarray:
    """A hash of each of some different words (large binary)."""
    ends = np.frombuffer(stock.buffers()[1], np.int64, len(stock) + 1, stock.offset * 8)
    return word_hashes(stock.buffers()[2].to_pybytes() if len(stock) else b"", ends[:-1], ends[1:])


def words_of(batch: pa.RecordBatch) -> Words:
    """Words of texts with A-Z lower-cased; pieces end at marks, line ends and with their text."""
    data, offsets = text_bytes(batch)
    data = data.translate(LOWER)
    raw = np.frombuffer(data, np.uint8)
    inside = ~BLANK_OR_END[raw]
    begins, last = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(raw))]
    begins[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(last) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    piece = np.searchsorted(np.flatnonzero(ENDS[raw]), starts) + text
    bounds = np.concatenate(([0], np.cumsum(ends - starts)))
    all_ = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw[inside])])
    coded = all_.dictionary_encode()
    stock = coded.dictionary.cast(pa.large_binary())
    named = pc.fill_null(batch["lang"].cast(pa.string()), UNKNOWN).dictionary_encode()
    langs = named.dictionary.to_pylist()
    lang = np.asarray(named.indices).astype(np.int64)[text] if len(text) else np.zeros(0, np.int64)
    return Words(np.asarray(coded.indices).astype(np.int64), piece, lang, stock, langs, hashes_of(stock), salts_of(langs))


class Buckets:
    """Counts of hashed grams, none higher than `least`: enough to tell which buckets have that many."""

    def __init__(self, size: int, least: int) -> None:
        self.least, self.mask = least, np.uint64(size - 1)
        self.counts = np.zeros(size, np.uint8 if least < 256 else np.uint32)

    def add(self, hashes: np.ndarray) -> None:
        at, n = np.unique(hashes & self.mask, return_counts=True)
        self.counts[at] = np.minimum(self.counts[at] + n, self.least)

    def batches(self) -> Iterator[pa.RecordBatch]:
        spans = self.counts.reshape(-1, SPAN)
        some = np.flatnonzero(spans.any(axis=1))
        for i in range(0, len(some), 1024):
            part = some[i : i + 1024]
            yield rows(len(part), span=pa.array(part, pa.int32()), buckets=pa.array([spans[s].tobytes() for s in part], pa.binary()))


def bitmap(raw: DataFrame, size: int, least: int) -> Broadcast:
    """The buckets with `least` or more, a bit each, sent to all executors: size / 8 bytes."""
    kind = np.uint8 if least < 256 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for span, counts in zip(batch["span"].to_pylist(), batch["buckets"]):
                new = np.frombuffer(counts.as_buffer(), kind)
                old = sums.get(span)
                sums[span] = new if old is None else np.minimum(old.astype(np.uint32) + new, least).astype(kind)
        bits = [np.packbits(c >= least, bitorder="little").tobytes() for c in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(bits, pa.binary())], names=["span", "bits"])

    spark, out = raw.sparkSession, np.zeros((size // SPAN, SPAN // 8), np.uint8)
    some = raw.where("span is not null").select("span", "buckets").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "span")
    for r in some.mapInArrow(run, "span int, bits binary").toLocalIterator():
        out[r.span] = np.frombuffer(bytes(r.bits), np.uint8)
    return spark.sparkContext.broadcast(out.ravel())


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def counting_pass(docs: DataFrame, k: int, size: int, least: int, longest: int, may: Broadcast | None, before: Broadcast | None) -> DataFrame:
    """Counts of k-grams that may be frequent, by batch of texts, and bucket counts of the (k+1)-grams made of them.

    may: buckets of k-grams; before: buckets of the frequent (k-1)-grams. In the first pass the row with an empty gram
    counts all words of a language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(size, least) if k < longest else None
        for batch in pieces(batches, limit=CHUNK):
            w = words_of(batch)
            good = w.together(k)
            if k == 1:
                n = np.bincount(w.lang, minlength=len(w.langs))
                yield rows(len(w.langs), lang=pa.array(w.langs, pa.string()), gram=pa.array([""] * len(w.langs), pa.string()), n=pa.array(n, pa.int64()))
            elif len(good):
                part = has(before.value, w.grams(k - 1))
                good &= part[:-1] & part[1:]
                at = np.flatnonzero(good)
                good[at] = has(may.value, w.grams(k)[at])
            at = np.flatnonzero(good)
            if len(at):
                yield w.counted(at, k)
                if buckets is not None and len(good) > 1:
                    longer = w.together(k + 1) & good[:-1] & good[1:]
                    buckets.add(w.grams(k + 1)[longer])
        if buckets is not None:
            yield from buckets.batches()

    return docs.mapInArrow(run, RAW)


def frequent_buckets(grams: DataFrame, k: int, size: int, least: int) -> Broadcast:
    """The buckets of frequent k-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(size, 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            langs = batch["lang"].dictionary_encode()
            coded = pc.split_pattern(batch["gram"].cast(pa.large_string()), " ").flatten().dictionary_encode()
            hashes = hashes_of(coded.dictionary.cast(pa.large_binary()))[np.asarray(coded.indices)].reshape(-1, k)
            lang = np.asarray(langs.indices)
            w = Words(np.arange(hashes.size), np.repeat(np.arange(len(hashes)), k), np.repeat(lang, k).astype(np.int64), coded.dictionary, [], hashes.ravel(), salts_of(langs.dictionary.to_pylist()))
            buckets.add(w.grams(k)[::k])
        yield from buckets.batches()

    return bitmap(grams.mapInArrow(run, RAW), size, 1)


def frequent_grams(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, buckets: int | None = None) -> DataFrame:
    """lang, k, gram (words joined by a space), n: all grams of 1 to `longest` words that occur `least` times or more in
    the texts of a language, and one row with k 0 for all words of each language."""
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = buckets
    if size is None:
        n = texts.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
        size = min(MOST_BUCKETS, max(FEWEST_BUCKETS, 1 << (int(n) // BYTES_PER_BUCKET).bit_length()))
    out, may, before = [], None, None
    for k in range(1, longest + 1):
        raw = keep(counting_pass(texts, k, size, least, longest, may, before), f"grams{k}")
        sums = raw.where("gram is not null").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        size_of = F.when(F.col("gram") == "", 0).otherwise(k).alias("k")
        grams = keep(sums.where((F.col("n") >= least) | (F.col("gram") == "")).select("lang", size_of, "gram", "n"), f"frequent{k}")
        out.append(grams)
        for old in (may, before):
            if old is not None:
                old.destroy()
        if k < longest:
            may, before = bitmap(raw, size, least), frequent_buckets(grams.where("k > 0"), k, size, least)
        discard(raw)
    return reduce(DataFrame.unionAll, out)


def collocations(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, best: int = BEST, inside: int = INSIDE, buckets: int | None = None) -> DataFrame:
    """The first `best` phrases of each language: lang, rank int, phrase, a, l, r, n, score long.

    A phrase of 2 to `longest` words occurs a times, `least` at least. Cut after its first k words, its parts occur l and
    r times; score is 2 000 000 a / (l + r) rounded down, at the cut where that is least (ties: the first). Phrases that
    a longer one holds, with at least `inside` hundredths of their own count, go. Order: score, a, phrase (bytes).
    Null texts are empty, a null lang is `und`; repeated rows count as often as they occur; an empty table gives no
    rows. Texts may have any length and are read whole; other columns are not read.
    """
    grams = frequent_grams(docs, least, longest, buckets)
    phrases = grams.where("k > 1").select("lang", F.col("gram").alias("phrase"), "k", F.col("n").alias("a"), F.split("gram", " ").alias("w"))
    big = lambda c: F.col(c).cast("decimal(20,0)")
    joined = lambda w, a, n: F.array_join(F.slice(w, a, n), " ")
    # Every shorter phrase that lies in a longer one, with the largest count of those.
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: joined(F.col("w"), i, m))))
    held = phrases.where("k > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    phrases = phrases.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * big("longer") < inside * big("a")))
    cut = phrases.select("lang", "phrase", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    cut = cut.select("lang", "phrase", "a", "at", joined("w", F.lit(1), F.col("at")).alias("first"), joined("w", F.col("at") + 1, F.col("k") - F.col("at")).alias("rest"))
    counts = grams.where(F.col("k").between(1, longest - 1))
    part = lambda g, n: counts.select("lang", F.col("gram").alias(g), F.col("n").alias(n))
    cut = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    weakest = cut.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct(score.alias("score"), "at", "l", "r")).alias("x"))
    ranked = weakest.select("lang", "phrase", "a", "x.l", "x.r", "x.score").withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    every = grams.where("k = 0").select("lang", "n")
    return ranked.where(F.col("rank") <= best).join(every, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language in all documents."""
    return collocations(load(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
q AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM d),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM q GROUP BY lang),
x AS (SELECT id, lang, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM q),
y AS (SELECT lang, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM x WINDOW o AS (PARTITION BY id ORDER BY i)),
g AS (SELECT lang, 1 AS k, w AS gram, count(*) AS f FROM y GROUP BY lang, w HAVING f >= 30
  UNION ALL SELECT lang, 2, w || ' ' || w2, count(*) AS f FROM y WHERE w2 IS NOT NULL GROUP BY lang, w, w2 HAVING f >= 30
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3, count(*) AS f FROM y WHERE w3 IS NOT NULL GROUP BY lang, w, w2, w3 HAVING f >= 30
  UNION ALL SELECT lang, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) AS f FROM y WHERE w4 IS NOT NULL GROUP BY lang, w, w2, w3, w4 HAVING f >= 30),
c AS (SELECT lang, k, gram AS phrase, f AS a, string_split(gram, ' ') AS w FROM g WHERE k > 1),
h AS (SELECT c.lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM c, range(2, 4) AS x(m), range(1, 4) AS y(i) WHERE m < k AND i + m - 1 <= k GROUP BY 1, 2),
s AS (SELECT c.* FROM c LEFT JOIN h ON c.lang = h.lang AND c.phrase = h.phrase WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a),
u AS (SELECT s.lang, s.phrase, s.a, k1, l.f AS l, r.f AS r, (CAST(2000000 AS HUGEINT) * s.a) // (l.f + r.f) AS score FROM s, range(1, 4) AS z(k1)
  JOIN g l ON l.lang = s.lang AND l.gram = array_to_string(s.w[1:k1], ' ') JOIN g r ON r.lang = s.lang AND r.gram = array_to_string(s.w[k1 + 1:s.k], ' ') WHERE k1 < s.k),
v AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k1) AS i FROM u),
o AS (SELECT lang, phrase, a, l, r, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM v WHERE i = 1)
SELECT o.lang, CAST(o.rank AS INT) AS rank, phrase, a, l, r, t.n, score FROM o JOIN t ON o.lang = t.lang WHERE rank <= 2000
"""
