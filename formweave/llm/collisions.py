"""Embedding near-duplicates by collision counting over sorted one-dimensional projections."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, ceil, comb, erf, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, load
from .components import connected_components, in_groups

#: Vectors that a cell holds on average, and those of a group that one task compares with another part of it.
CELL_ROWS, PART_ROWS = 512, 2048
#: Projections counted for all pairs that a sort lets meet, and those counted after them for the pairs still possible.
FIRST, THEN = 8, 24
#: Tasks that one class of equal vectors is dealt to when its rows get their result.
SALTS = 8


def within(width: float, distance: float) -> float:
    """Chance that a Gaussian projection of two points at this distance differs by at most width."""
    return erf(width / distance / sqrt(2))


def at_least(n: int, k: int, p: float) -> float:
    return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))


class Sorts:
    """The sorts of a table of `count` vectors and the counts to pass, for a pair just at the cosine.

    Each sort deals the vectors to cells by the signs of some projections, so many that a cell holds CELL_ROWS on
    average, and sorts each cell by one more. Such a pair meets in the window of one of the sorts, and passes both
    counts, with a chance of at least `recall` (each of the three misses a third of the rest).
    """

    def __init__(self, count: int, cosine: float, recall: float):
        distance, each = sqrt(2 - 2 * cosine), 1 - (1 - recall) / 3

        def width(p: float) -> float:
            lo, hi = 0.0, 10 * distance
            for _ in range(60):
                lo, hi = (lo, (lo + hi) / 2) if within((lo + hi) / 2, distance) >= p else ((lo + hi) / 2, hi)
            return hi

        self.cosine, self.wide = cosine, width(0.95)
        self.narrow = self.wide
        p = within(self.narrow, distance)
        self.first = max(k for k in range(FIRST + 1) if at_least(FIRST, k, p) >= each)
        self.both = max(k for k in range(FIRST + THEN + 1) if at_least(FIRST + THEN, k, p) >= each)
        self.bits = min(40, max(0, ceil(log2(max(1, count) / CELL_ROWS))))
        meet = p * (1 - acos(cosine) / pi) ** self.bits
        self.tables = ceil(log(1 - each) / log(1 - meet))

    def counted(self, unit: np.ndarray) -> np.ndarray:
        """(FIRST + THEN, n) projections to count collisions in."""
        return (unit @ directions(unit.shape[1], 0, FIRST + THEN)).astype(np.float32).T.copy()

    def sorted_by(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, tables) cells, and places in the sort of each."""
        x = (unit @ directions(unit.shape[1], 1, self.tables * (self.bits + 1))).reshape(len(unit), self.tables, self.bits + 1)
        return ((x[:, :, :-1] > 0) << np.arange(self.bits)).sum(axis=2, dtype=np.int64), x[:, :, -1]


@lru_cache(8)
def directions(dim: int, kind: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([dim, 6, kind])).standard_normal((n, dim)).T.copy()


def units(values: list[bytes], dim: int) -> np.ndarray:
    """Vectors of length one, in double precision."""
    x = np.frombuffer(b"".join(values), "<f4" if len(values[0]) == 4 * dim else "<f8").reshape(len(values), dim) if len({len(v) for v in values}) == 1 else np.stack([np.frombuffer(v, "<f4" if len(v) == 4 * dim else "<f8").astype(np.float64) for v in values])
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(rows: DataFrame, column: str) -> DataFrame:
    """vec_id (one row each), v (components as binary; null: links with nothing) and dim. Components that single
    precision holds exactly are stored so; equal vectors have equal v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, dims = [], []
            for v in batch["x"]:
                x = None if v.values is None or v.values.null_count else np.asarray(v.values) + 0.0  # one zero
                good = x is not None and len(x) > 0 and np.isfinite(x).all() and x.any()
                if good:
                    with np.errstate(over="ignore"):
                        short = x.astype("<f4")
                    out.append((short if (short == x).all() else x.astype("<f8")).tobytes())
                else:
                    out.append(None)
                dims.append(len(x) if good else None)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(out, pa.binary()), pa.array(dims, pa.int32())], names=["vec_id", "v", "dim"])

    one = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("x")).where("vec_id is not null").groupBy("vec_id").agg(F.max("x").alias("x"))
    return one.mapInArrow(run, "vec_id long, v binary, dim int")


def dealt(classes: DataFrame, sorts: Sorts) -> DataFrame:
    """dim, sort, cell, node, n, v: each class in its cell of each sort."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch["dim"])
            for dim in np.unique(dims).tolist():
                some = batch.filter(pa.array(dims == dim))
                for part in (some.slice(i, 1024) for i in range(0, some.num_rows, 1024)):
                    cells, _ = sorts.sorted_by(units(part["v"].to_pylist(), dim))
                    for t in range(sorts.tables):
                        yield pa.RecordBatch.from_arrays([part["dim"], pa.array(np.full(part.num_rows, t, np.int32)), pa.array(cells[:, t]), part["node"], part["n"], part["v"]], names=["dim", "sort", "cell", "node", "n", "v"])

    return classes.select("dim", "node", "n", "v").mapInArrow(run, "dim int, sort int, cell long, node long, n long, v binary")


def compare(sorts: Sorts, tile: int = 256):
    """For the vectors of one cell of a sort: (a, b, n) for each vector a with links that are found here first: a
    vector b joined to it and its n links."""

    def one(table: pa.Table) -> pa.RecordBatch:
        dim, sort = int(table["dim"][0].as_py()), int(table["sort"][0].as_py())
        cross, left = table["_i"][0].as_py() != table["_j"][0].as_py(), np.asarray(table["_left"])
        ids, weight, unit = np.asarray(table["node"]), np.asarray(table["n"]), units(table["v"].to_pylist(), dim)
        place, (cells, where) = sorts.counted(unit), sorts.sorted_by(unit)
        at_sort = where[:, sort]
        order = np.argsort(at_sort, kind="stable")
        a_all, b_all = (order[left[order]], order[~left[order]]) if cross else (order, order)
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for at in range(0, len(a_all), tile):
            a = a_all[at : at + tile]
            b = b_all[np.searchsorted(at_sort[b_all], at_sort[a[0]] - sorts.wide) : np.searchsorted(at_sort[b_all], at_sort[a[-1]] + sorts.wide, "right")]
            if not len(b):
                continue
            count = np.zeros((len(a), len(b)), np.uint8)
            for k in range(FIRST):
                count += np.abs(place[k, a][:, None] - place[k, b][None, :]) <= sorts.narrow
            i, j = np.nonzero(count >= sorts.first)
            x, y = a[i], b[j]
            some = np.abs(at_sort[x] - at_sort[y]) <= sorts.wide
            some &= True if cross else ids[x] < ids[y]
            x, y, c = x[some], y[some], count[i, j][some].astype(np.int64)
            for k in range(FIRST, FIRST + THEN):
                c += np.abs(place[k, x] - place[k, y]) <= sorts.narrow
                possible = c + (FIRST + THEN - 1 - k) >= sorts.both
                x, y, c = x[possible], y[possible], c[possible]
            for s in range(0, len(x), 1 << 16):  # verification in double precision
                u, v = x[s : s + (1 << 16)], y[s : s + (1 << 16)]
                true = (unit[u] * unit[v]).sum(axis=1) >= sorts.cosine
                u, v = u[true], v[true]
                for t in range(sort):  # pairs that an earlier sort let meet were counted there
                    new = (cells[u, t] != cells[v, t]) | (np.abs(where[u, t] - where[v, t]) > sorts.wide)
                    u, v = u[new], v[new]
                links += np.bincount(u, weight[v], len(ids)).astype(np.int64) + np.bincount(v, weight[u], len(ids)).astype(np.int64)
                while True:  # labels of joined vectors meet at the smallest
                    low = np.minimum(label[u], label[v])
                    if (label[u] == low).all() and (label[v] == low).all():
                        break
                    np.minimum.at(label, label[u], low)
                    np.minimum.at(label, label[v], low)
                    while (label != label[label]).any():
                        label = label[label]
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[label[some]]), pa.array(links[some])], names=["a", "b", "n"])

    def run(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield one(table.slice(s, e - s))

    return run


def embedding_near_dedup(rows: DataFrame, cosine: float = 0.9, recall: float = 0.95, column: str = "embedding") -> DataFrame:
    """One row for each vec_id: n_links (other vectors with at least this cosine), component_id, kept.

    Vectors are sorted several times by random projections, within cells that keep a sort's work in proportion to
    its rows. Around each vector, a window of the sort is compared: pairs are counted over further projections in
    which both fall into one window around the first, and those that pass the calibrated counts are verified by
    cosine in double precision: no link is wrong, and a pair just at the threshold is found with at least the chance
    `recall`. A pair counts in the first sort that lets it meet. Cells that hold many vectors are split into parts.
    Equal vectors are one class and are never expanded into pairs. Vectors that are null, empty, zero or hold null
    or non-finite components link with nothing; those of different lengths do not link. Rows with a null vec_id
    have no name to return and are left out; rows of one vec_id are one vector (the greatest).
    """
    every = keep(usable(rows, column), "vectors")
    classes = keep(every.where("v is not null").groupBy("v", "dim").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")), "classes")
    sorts = Sorts(classes.count(), cosine, recall)
    found = keep(in_groups(dealt(classes, sorts), ["dim", "sort", "cell"], compare(sorts), "a long, b long, n long", PART_ROWS), "found")
    links = found.groupBy("a").agg(F.sum("n").alias("linked"))
    named = connected_components(found.select("a", "b"))
    classes = classes.join(links, F.col("node") == F.col("a"), "left").drop("a")
    classes = classes.join(named.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    # rows meet their class by a digest of the vector, a frequent one in several tasks
    digest = [F.xxhash64("dim", "v").alias("h1"), F.xxhash64("v", "dim").alias("h2")]
    result = ((F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    classes = classes.select(*digest, *result, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    vectors = every.where("v is not null").select("vec_id", *digest, F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt"))
    linked = vectors.join(classes, ["h1", "h2", "salt"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = every.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(load(spark, sf_dir, "embeddings"))
