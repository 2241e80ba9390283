"""Running values over any order, in many tasks: range partitions, local windows, and what the partitions before add.

A window without a partition, or with a hot one, is one task. Here rows are cut by ranges of their order into blocks;
each block is a window of its own, and one row for each group and block tells the later ones what came before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from formweave.sources.sinks import kept

BLOCK, GROUP = "_block", "_group"


def in_blocks(rows: DataFrame, group: list[str], order: list[str | Column], name: str = "blocks") -> DataFrame:
    """rows with GROUP (a struct of `group`, so nulls are a group too) and BLOCK, which rises with group and order."""
    keys = [F.col(c) if isinstance(c, str) else c for c in (*group, *order)]
    ranged = rows.withColumn(GROUP, F.struct(F.lit(0).alias("all"), *(F.col(c) for c in group))).repartitionByRange(*keys)
    return kept(ranged.withColumn(BLOCK, F.spark_partition_id()), name)


def up_to(order: list[str | Column], last: int = W.currentRow):
    """The window over the rows of a block and group up to the present one (last: how many after it)."""
    return W.partitionBy(GROUP, BLOCK).orderBy(*order).rowsBetween(W.unboundedPreceding, last)


def before_block(sums: DataFrame, **values: Column) -> DataFrame:
    """sums (GROUP, BLOCK, ...), a row for each, with aggregates of the blocks of the group that come before."""
    w = W.partitionBy(GROUP).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    return sums.select(GROUP, BLOCK, *(v.over(w).alias(n) for n, v in values.items()))


def running(blocks: DataFrame, order: list[str | Column], value: Column, name: str, how: Callable[[Column], Column] = F.sum) -> DataFrame:
    """blocks (from in_blocks) with the sum (or F.min, F.max) of `value` over the group's rows up to each one."""
    sums = before_block(blocks.groupBy(GROUP, BLOCK).agg(how(value).alias("_v")), _before=how(F.col("_v")))
    out = blocks.withColumn(name, how(value).over(up_to(order))).join(sums, [GROUP, BLOCK])
    both = F.coalesce("_before", F.lit(0)) + F.col(name) if how is F.sum else (F.least if how is F.min else F.greatest)("_before", F.col(name))
    return out.withColumn(name, both).drop("_before")


def numbered(rows: DataFrame, order: list[str | Column], name: str = "place") -> DataFrame:
    """rows numbered from 1 in the given order (which should leave no ties), by ranges and their counts."""
    out = running(in_blocks(rows, [], order, "numbered"), order, F.lit(1).cast("long"), name)
    return out.drop(GROUP, BLOCK)
