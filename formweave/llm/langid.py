"""Language identification by rank-order profiles of character n-grams (out-of-place distance)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import load, pieces

#: N-grams of one to three characters, and how many of the most frequent make a profile.
PROFILE_SIZE = 300
EDGE = 32
UNKNOWN = "und"


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text (null: empty text) modulo folds is fold."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


@lru_cache(1)
def letters() -> np.ndarray:
    """By code point: the lower-cased letter, or EDGE for what is no letter."""
    table = np.full(0x110000, EDGE, np.uint64)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


def letter_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as letters with one EDGE between words, after a first EDGE; and where each text begins in it."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    x = letters()[np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)]
    kept = np.ones(len(x), bool)
    kept[1:] = (x[1:] != EDGE) | (x[:-1] != EDGE)
    before = np.zeros(len(x) + 1, np.int64)
    np.cumsum(kept, out=before[1:])
    return np.concatenate(([np.uint64(EDGE)], x[kept])), before[np.concatenate(([0], np.cumsum(sizes)))] + 1


def grams(x: np.ndarray) -> np.ndarray:
    """Codes of all n-grams of one run of letters that begins and ends with EDGE; none has an EDGE inside."""
    high = x << np.uint64(42)
    two = x[1:] << np.uint64(21)
    inner = x[1:-1] != EDGE
    return np.concatenate((high[x != EDGE], high[:-1] | two, (high[:-2] | two[:-1] | x[2:])[inner]))


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    return codes[at], np.diff(np.append(at, len(codes)))


def learn_profiles(docs: DataFrame, size: int = PROFILE_SIZE) -> dict[str, np.ndarray]:
    """The `size` most frequent n-gram codes of each language, by rank (ties: smaller code first).

    Counts cover every labelled row of docs. Tasks count before the shuffle, and only the profiles, `size` codes
    for each language, come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in pieces(batches, limit=1 << 20):
            langs = np.array(batch["lang"].to_pylist(), object)
            texts = batch["text"].to_pylist()
            for lang in sorted(set(langs)):
                x, _ = letter_runs([texts[i] for i in np.flatnonzero(langs == lang)])
                held.setdefault(lang, []).append(distinct(grams(x)) if len(x) > 2 else distinct(x[:0]))
                if len(held[lang]) >= 16:
                    held[lang] = [add(held[lang])]
        for lang, parts in held.items():
            codes, n = add(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.view(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    rows = docs.where("text is not null and lang is not null").select("lang", "text").mapInArrow(count, "lang string, code long, n long")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "code"))
    best = rows.groupBy("lang", "code").agg(F.sum("n").alias("n")).withColumn("r", rank).where(F.col("r") <= size)
    out: dict[str, list] = {}
    for row in best.select("lang", "r", "code").collect():
        out.setdefault(row.lang, []).append((row.r, row.code))
    return {lang: np.array([c for _, c in sorted(out[lang])], np.int64).view(np.uint64) for lang in sorted(out)}


def add(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE_SIZE) -> DataFrame:
    """docs with lang_pred string and score double (0 to 1: one less the out-of-place distance over its largest).

    N-grams of a text are ranked by frequency, equal ones by code. An n-gram that a profile lacks is `size` places out. Equal distances: the language first by code point. Texts
    that are null or have no letter, and all texts where nothing was learned, are `und` with score 0. Columns of
    these two names are replaced; text is the only input, taken whole however long. Repeated rows get equal results.
    """
    langs = sorted(profiles)
    known = np.unique(np.concatenate([profiles[k] for k in langs])) if langs else np.zeros(0, np.uint64)
    places = np.full((len(langs), len(known) + 1), -1, np.int64)
    for i, k in enumerate(langs):
        places[i, np.searchsorted(known, profiles[k])] = np.arange(len(profiles[k]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=1 << 20):
            texts = pc.fill_null(batch["text"], "").to_pylist()
            x, first = letter_runs(texts)
            named, scores = [], []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                codes, n = distinct(grams(x[a - 1 : b])) if b - a > 1 and langs else (x[:0], x[:0])
                if not len(codes):
                    named.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                codes = codes[np.argsort(-n, kind="stable")[:size]]
                at = np.searchsorted(known, codes)
                at[at == len(known)] = 0
                there = places[:, np.where(known[at] == codes, at, len(known))]
                out = np.where(there < 0, size, np.abs(there - np.arange(len(codes)))).sum(axis=1)
                best = int(out.argmin())
                named.append(langs[best])
                scores.append(1 - float(out[best]) / (size * len(codes)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(named, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    docs = docs.drop("lang_pred", "score")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def learned_from(docs: DataFrame, folds: int = 5, fold: int = 0) -> dict[str, np.ndarray]:
    """Profiles from the rows outside one fold."""
    return learn_profiles(docs.where(~in_fold(F.col("doc_id"), folds, fold)))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), learned_from(docs))
    return found.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, text, coalesce(CAST(doc_id AS VARCHAR), '') AS k FROM documents),
c AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(k) + 1), lambda i: CAST(ord(substr(k, i, 1)) AS BIGINT))),
  lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) % 5 = 0 AS held_out FROM d),
t AS (SELECT *, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}]+', ' ', 'g')) || ' ' AS x FROM c),
n AS (SELECT r, unnest(range(1, length(x) + 1)) AS i, x FROM t WHERE length(x) > 2),
g AS (SELECT r, unnest([CASE WHEN substr(x, i, 1) <> ' ' THEN substr(x, i, 1) END, CASE WHEN i < length(x) THEN substr(x, i, 2) END, CASE WHEN i + 1 < length(x) AND substr(x, i + 1, 1) <> ' ' THEN substr(x, i, 3) END]) AS g FROM n),
m AS (SELECT r, g, count(*) AS n FROM g WHERE g IS NOT NULL GROUP BY r, g),
p AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) - 1 AS place FROM (SELECT lang, g, sum(n) AS n FROM m JOIN c USING (r) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g)),
q AS (SELECT lang, g, place FROM p WHERE place < 300), l AS (SELECT DISTINCT lang FROM q),
o AS (SELECT r, g, row_number() OVER (PARTITION BY r ORDER BY n DESC, g) - 1 AS place FROM m),
s AS (SELECT o.r, l.lang, sum(CASE WHEN q.place IS NULL THEN 300 ELSE abs(q.place - o.place) END) AS away, count(*) AS n FROM o CROSS JOIN l LEFT JOIN q ON q.lang = l.lang AND q.g = o.g WHERE o.place < 300 GROUP BY o.r, l.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY away, lang) AS i FROM s)
SELECT c.doc_id, c.held_out, coalesce(b.lang, 'und') AS lang_pred, CASE WHEN b.lang IS NULL THEN 0.0 ELSE 1 - CAST(b.away AS DOUBLE) / (300 * b.n) END AS score FROM c LEFT JOIN b ON c.r = b.r AND b.i = 1
"""
