"""Exact top-k by inner product with MaxScore: postings by dimension, bounds that split the terms of a query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import keep, load, longs

#: Vectors of a shard, and queries that go through its postings in one task.
SHARD_ROWS, QUERY_ROWS = 8192, 4096
#: Terms whose first postings give a query's first threshold.
SEED_TERMS = 8
STEP = 8
#: Vectors with more components, or with one of this size (as a whole number), have no postings but are scored one by one.
WIDE, BIG = 4096, 1 << 31
#: Components in the postings of a shard at most, and rows that are scored at once in whole numbers of any size.
CELLS, AT_ONCE = 1 << 24, 256
#: Sums are exact in 64 bits if no sum of their parts' sizes exceeds this.
SAFE = float(1 << 62)
MOST = (1 << 63) - 1


def integer_vectors(rows: DataFrame, column: str, scale: float) -> DataFrame:
    """vec_id, v (integers of 16 or 32 bits, larger ones as whole doubles) and size: floor(scale * x) of each component;
    rows that cannot take part go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["x"]
            ids, out, size = [], [], []
            for i, v in zip(batch["vec_id"].to_pylist(), lists):
                x = v.values
                if x is None or x.null_count:
                    continue
                x = np.floor(scale * np.asarray(x.cast(pa.float64())))
                if np.isfinite(x).all():
                    ids.append(i)
                    most = np.abs(x).max(initial=0)
                    out.append(x.astype("<i2" if most < 1 << 15 else "<i4" if most < BIG else "<f8").tobytes())
                    size.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(size, pa.int32())], names=["vec_id", "v", "size"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("x")).where("vec_id is not null").mapInArrow(run, "vec_id long, v binary, size int")


def unpacked(v: bytes, size: int) -> np.ndarray:
    """Integers of 64 bits, or Python's own where these do not do."""
    if len(v) == 8 * size and size:
        x = np.frombuffer(v, "<f8")
        return x.astype(np.int64) if np.abs(x).max() < SAFE else np.array([int(c) for c in x], object)
    return np.frombuffer(v, "<i2" if len(v) == 2 * size else "<i4").astype(np.int64)


def exact_product(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if np.abs(a.astype(float)) @ np.abs(b.astype(float)) < SAFE:
        return int(a.astype(np.int64) @ b.astype(np.int64)) if n else 0
    return sum(int(x) * int(y) for x, y in zip(a, b))


class Shard:
    """Postings of some vectors: for each dimension and sign the rows with such a component, strongest first.

    Very long vectors and those with very large components stand apart and are scored one by one.
    """

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray]):
        regular = np.array([len(v) <= WIDE and (v.dtype != object and np.abs(v).max(initial=0) < BIG) for v in vectors], bool)
        self.apart = [(i, v) for i, v, r in zip(ids.tolist(), vectors, regular) if not r]
        self.ids, vectors = ids[regular], [v for v, r in zip(vectors, regular) if r]
        width = max((len(v) for v in vectors), default=0)
        self.columns = np.zeros((width, len(vectors)), np.int64)  # shorter vectors have no posting in the rest
        for i, v in enumerate(vectors):
            self.columns[: len(v), i] = v
        order = np.argsort(-self.columns, axis=1, kind="stable")
        self.high, self.low = self.columns.max(axis=1, initial=0), self.columns.min(axis=1, initial=0)
        above, below = (self.columns > 0).sum(axis=1), (self.columns < 0).sum(axis=1)
        #: By sign of the query's component: the rows that it adds something to, those that it adds most to first.
        self.postings = {1: [o[:n] for o, n in zip(order, above)], -1: [o[::-1][:n] for o, n in zip(order, below)]}

    def search(self, own: int, query: np.ndarray, k: int, known: int | None = None) -> tuple[list[int], list[int]]:
        """Ids and scores of the k best rows but those whose id is `own`, best first; rows below `known`, a score that
        k other rows reach, may be left out. Scores that 64 bits cannot hold are given as the nearest that they can."""
        used = query[: len(self.columns)]
        most = np.maximum(np.abs(self.high), np.abs(self.low))[: len(used)].astype(float)
        if query.dtype != object and np.abs(used.astype(float)) @ most < SAFE:
            best = list(zip(*(x.tolist() for x in self.by_terms(own, used, k, known))))
        else:
            best = self.one_by_one(own, used, k)
        best += [(i, exact_product(query, v)) for i, v in self.apart if i != own]
        best = sorted(best, key=lambda x: (-x[1], x[0]))[:k]
        return [i for i, _ in best], [max(-MOST, min(MOST, s)) for _, s in best]

    def one_by_one(self, own: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """search() without terms, in whole numbers of any size, for the rows that have postings."""
        best: list[tuple[int, int]] = []
        query = np.array([int(x) for x in query], object)
        for i in range(0, len(self.ids), AT_ONCE):
            part = self.columns[: len(query), i : i + AT_ONCE].astype(object)
            scores = query @ part if len(query) else [0] * part.shape[1]
            best += [(j, s) for j, s in zip(self.ids[i : i + AT_ONCE].tolist(), scores) if j != own]
            best = sorted(best, key=lambda x: (-x[1], x[0]))[:k]
        return best

    def by_terms(self, own: int, query: np.ndarray, k: int, known: int | None) -> tuple[np.ndarray, np.ndarray]:
        gain = np.maximum(query * self.high[: len(query)], query * self.low[: len(query)])
        bound = np.maximum(0, gain)
        terms = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[terms][::-1])[::-1], 0)  # most that terms i, i + 1, ... can add
        floor = np.minimum(0, np.minimum(query * self.high[: len(query)], query * self.low[: len(query)]))
        least = np.append(np.cumsum(floor[terms][::-1])[::-1], 0)
        posting = lambda t: self.postings[1 if query[t] > 0 else -1][t] if query[t] else self.ids[:0]
        valid = self.ids != own
        threshold = known
        seed = np.unique(np.concatenate([posting(t)[: 2 * k] for t in terms[:SEED_TERMS]])) if len(terms) else np.zeros(0, np.int64)
        seed = seed[valid[seed]]
        if len(seed) >= k:
            own_best = int(np.partition(query @ self.columns[: len(query), seed], -k)[-k])
            threshold = own_best if threshold is None else max(threshold, own_best)
        if threshold is None or threshold <= 0:
            rows, essential = np.flatnonzero(valid), 0  # a row without any posting can be among the best
        else:
            essential = int(np.argmax(rest < threshold))  # the terms from here on cannot reach it by themselves
            found = np.zeros(len(valid), bool)
            for t in terms[:essential]:
                found[posting(t)] = True
                if found.all():
                    break
            rows = np.flatnonzero(found & valid)
        score = np.zeros(len(rows), np.int64)
        for i in range(0, len(terms), STEP):
            for t in terms[i : i + STEP]:
                score += query[t] * self.columns[t, rows]
            done = min(i + STEP, len(terms))
            if threshold is not None and done >= essential and len(rows):
                if len(rows) > k:
                    threshold = max(threshold, int(np.partition(score + least[done], -k)[-k]))
                alive = score + rest[done] >= threshold
                rows, score = rows[alive], score[alive]
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[best]], score[best]


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, column: str = "embedding", scale: float = 1024.0, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k rows with the highest integer inner product for each query: query_id, rank, vec_id, score.

    rows and queries have vec_id and `column`. Components become floor(scale * x), whatever their size; rows
    whose vector is null or holds null or non-finite components, or whose vec_id is null, take no part. Rows with
    the query's vec_id are its own and no candidates. Vectors of other lengths count as filled up with zeros. Ties
    go to the smaller vec_id; equal rows are rows like others. Scores are exact; one beyond 64 bits is given as the
    nearest long. An empty table gives no rows. A shard's postings have at most CELLS components, however long a vector is.

    A shard of bounded size gets its postings once for a block of thousands of queries. The first shard is searched
    before all others, and the score of its k-th row is where every query begins in these. The shards' best rows are
    merged by a window that keeps k for each query and task before its shuffle.
    """
    base = keep(integer_vectors(rows, column, scale), "vectors")
    asked = keep(integer_vectors(queries, column, scale).distinct().withColumn("q", F.xxhash64("v")), "queries")
    count, width = base.agg(F.count("*"), F.coalesce(F.max(F.least("size", F.lit(WIDE))), F.lit(0))).first()
    shards = max(1, -(-count // min(shard_rows, CELLS // max(1, width))))
    blocks = max(1, -(-asked.count() // query_rows))
    every = lambda first, n: F.explode(F.sequence(F.lit(first), F.lit(n - 1)))
    left = base.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("block", every(0, blocks))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))

    def search(shard: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if shard.num_rows and block.num_rows:
            index = Shard(longs(shard, "vec_id"), [unpacked(v, n) for v, n in zip(shard["v"].to_pylist(), shard["size"].to_pylist())])
            for q, h, v, n, known in zip(*(block[c].to_pylist() for c in ("vec_id", "q", "v", "size", "known"))):
                ids, scores = index.search(q, unpacked(v, n), k, known)
                out += zip([q] * len(ids), [h] * len(ids), ids, scores)
        return pa.Table.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["query_id", "q", "vec_id", "score"])

    def found(shard_rows_: DataFrame, asked_: DataFrame) -> DataFrame:
        return shard_rows_.groupBy("shard", "block").cogroup(asked_.groupBy("shard", "block")).applyInArrow(search, "query_id long, q long, vec_id long, score long")

    first = keep(found(left.where("shard = 0"), asked.withColumns({"shard": F.lit(0), "known": F.lit(None).cast("long")})), "first")
    if shards == 1:
        return ranked(first, k)
    reached = first.groupBy("query_id", "q").agg(F.when(F.count("*") >= k, F.min("score")).alias("known")).withColumnsRenamed({"query_id": "_id", "q": "_q"})
    begun = asked.join(reached, (F.col("vec_id") == F.col("_id")) & (F.col("q") == F.col("_q")), "left").drop("_id", "_q")
    others = found(left.where("shard > 0"), begun.withColumn("shard", every(1, shards)))
    return ranked(first.unionByName(others), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 100 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
