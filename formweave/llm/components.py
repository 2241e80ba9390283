"""Connected components by alternating large-star and small-star steps, and pairs inside groups of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep

#: Rows of a group that one task compares; larger groups are split into pairs of such parts.
PART_ROWS = 1024


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a long, b long); component: the smallest node reachable.

    Each round keeps one table of edges in the shared folder and deletes the one before. Neighbours are never collected: a step is an
    aggregation with a map-side combine and a join whose skewed partitions Spark may split.
    """

    def signature(e: DataFrame) -> tuple:
        row = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (mark := signature(now)) != before:
        before = mark
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # large star: each larger neighbour of u moves to the smallest around u
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = keep(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        # small star: each smaller neighbour of u, and u, move to the smallest of them
        joined = large.join(least, F.col("a") == F.col("u"))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        last, now = now, keep(small.where("a <> b").distinct(), "edges")
        discard(last, large)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).groupBy("node").agg(F.min("component").alias("component"))


def in_groups(members: DataFrame, key: list[str], compare: Callable, schema: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Rows that compare(batch, left) yields for all members of each group of `key`, in parts of bounded size.

    A group of up to part_rows members is one comparison. A larger one is split by a hash of its rows into parts,
    and each pair of parts is a comparison, so that no task gets a whole hot group. compare gets a table of rows and
    the row numbers at which groups begin (and the last one ends). In a group with _i = _j all pairs are wanted, in
    others those of a row with _left true and one with _left false.
    """
    sizes = members.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1")
    cols = members.columns
    split = members.join(sizes, key).select(*cols, F.ceil(F.col("_n") / part_rows).cast("int").alias("_parts"))
    split = split.withColumn("_part", F.pmod(F.xxhash64(*cols, F.lit(7)), F.col("_parts")).cast("int"))
    split = split.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    tasks = split.select(*cols, F.least("_part", "_other").alias("_i"), F.greatest("_part", "_other").alias("_j"), (F.col("_part") <= F.col("_other")).alias("_left"))
    return in_parts(tasks, key, compare, schema)


def in_parts(tasks: DataFrame, key: list[str], compare: Callable, schema: str) -> DataFrame:
    """Rows that compare() yields for members as in_groups() deals them, with _i, _j and _left."""
    by = [*key, "_i", "_j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            change = _changes(table, by)
            cut = change[-1] if len(change) else 0
            if cut:
                yield from compare(table.slice(0, cut), np.concatenate(([0], change)))
            rest = table.slice(cut).combine_chunks()
        if rest is not None and rest.num_rows:
            yield from compare(rest, np.concatenate(([0], _changes(rest, by), [rest.num_rows])))

    return tasks.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def _changes(table: pa.Table, by: list[str]) -> np.ndarray:
    """Row numbers, after 0, at which the group differs from the row before."""
    differ = np.zeros(max(0, table.num_rows - 1), bool)
    for c in by:
        x = np.asarray(table[c])
        differ |= x[1:] != x[:-1]
    return np.flatnonzero(differ) + 1


def forest(close: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix of links, the smallest row number reachable from each row."""
    n = len(close)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(close, label[None, :], n).min(axis=1, initial=n))
        new = new[new]
        if (new == label).all():
            return label
        label = new
