"""Forms that were cut in two: halves joined in order of arrival, or by their column on the page."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from formweave.functions.text import tokens
from formweave.operators.ordered import BLOCK, GROUP, before_block, in_blocks, up_to

# What a card number and a closing code look like, and how many words a whole form has.
CARD, CODE, WHOLE = "^[Cc][-\\s]?[0-9]{6,}$", "^[A-Za-z0-9]{13,18}$", 66
MIDDLE = 0.5


def is_start(words: Column) -> Column:
    """A record number stands in the first two words."""
    return (F.size(words) > 0) & F.array_join(F.slice(words, 1, 2), " ").rlike("@\\s*[0-9]{4,6}")


def is_complete(words: Column) -> Column:
    """A card number anywhere, a code at the end, or the length of a whole form."""
    return (F.size(words) > 0) & (F.exists(words, lambda w: w.rlike(CARD)) | F.element_at(words, -1).rlike(CODE) | (F.size(words) >= WHOLE))


def classify(parts: DataFrame) -> DataFrame:
    """parts (text) with kind: complete, partial or continuation; blank texts go."""
    words = tokens(F.coalesce("text", F.lit("")))
    some = parts.withColumn("_w", words).where(F.size("_w") > 0)
    return some.withColumn("kind", F.when(~is_start(F.col("_w")), "continuation").when(is_complete(F.col("_w")), "complete").otherwise("partial")).drop("_w")


def stitch_in_order(parts: DataFrame) -> DataFrame:
    """parts (folder, pos, text, kind) joined first in, first out: folder, pos (where the result was ready), text, state.

    state is complete, joined, orphan (a continuation with nothing open) or open (a partial left over). A queue in
    SQL: with S the running count of partials less continuations and M the least S so far (0 at most), a continuation
    is an orphan where M falls, and otherwise the k-th joins the k-th partial.
    """
    w = W.partitionBy("folder").orderBy("pos")
    step = F.when(F.col("kind") == "partial", 1).when(F.col("kind") == "continuation", -1).otherwise(0)
    s = parts.withColumn("s", F.sum(step).over(w)).withColumn("m", F.least(F.lit(0), F.min("s").over(w)))
    orphan = (F.col("kind") == "continuation") & (F.col("m") < F.coalesce(F.lag("m").over(w), F.lit(0)))
    s = s.withColumn("orphan", orphan)
    fits = (F.col("kind") == "continuation") & ~F.col("orphan")
    s = s.withColumn("k", F.when(F.col("kind") == "partial", F.sum((F.col("kind") == "partial").cast("int")).over(w)).when(fits, F.sum(fits.cast("int")).over(w)))
    tops = s.where("kind = 'partial'").select("folder", "k", F.col("pos").alias("top"), F.col("text").alias("head"))
    ends = s.where(fits).select("folder", "k", "pos", "text")
    both = tops.join(ends, ["folder", "k"], "left")
    pairs = both.select("folder", F.coalesce("pos", "top").alias("pos"), F.concat_ws(" ", "head", "text").alias("text"), F.when(F.col("pos").isNull(), "open").otherwise("joined").alias("state"))
    alone = s.where("orphan or kind = 'complete'").select("folder", "pos", "text", F.when(F.col("orphan"), "orphan").otherwise("complete").alias("state"))
    return pairs.unionByName(alone)


class Open:
    """Open halves: the nearest by column is taken, the first of equals. Columns are few, so places are found by search."""

    def __init__(self, held: list[tuple[int, str, float]] = ()) -> None:
        self.columns: list[float] = []
        self.at: dict[float, deque] = {}
        self.n = self.added = 0
        for pos, text, col in held:
            self.add(pos, text, col)

    def add(self, pos: int, text: str, col: float) -> None:
        if col not in self.at:
            insort(self.columns, col)
            self.at[col] = deque()
        self.at[col].append((self.added, pos, text))
        self.added, self.n = self.added + 1, self.n + 1

    def take(self, col: float) -> tuple[int, str]:
        cols, i = self.columns, bisect_left(self.columns, col)
        near = min(abs(c - col) for c in cols[max(0, i - 1) : i + 1])
        low, high = i, i
        while low and abs(cols[low - 1] - col) == near:
            low -= 1
        while high < len(cols) and abs(cols[high] - col) == near:
            high += 1
        c = min(cols[low:high], key=lambda c: self.at[c][0][0])
        _, pos, text = self.at[c].popleft()
        if not self.at[c]:
            del self.at[c]
            cols.remove(c)
        self.n -= 1
        return pos, text

    def left(self) -> list[tuple[int, str, float]]:
        return [(pos, text, col) for _, pos, text, col in sorted((*x, c) for c, held in self.at.items() for x in held)]


def column_of(col: float | None) -> float:
    return MIDDLE if col is None or col != col else col


def by_column(rows: list[tuple[int, str, float | None, str]], open_: list[tuple[int, str, float]]) -> tuple[list[tuple[int, str, str]], list[tuple[int, str, float]]]:
    """One folder in order: (pos, text, column, kind) joined to the open partial nearest by column (the first of
    equals). Gives what is ready (pos, text, state) and what stays open."""
    ready, held = [], Open(open_)
    for pos, text, col, kind in rows:
        if kind == "partial":
            held.add(pos, text, column_of(col))
        elif kind == "continuation" and held.n:
            ready.append((pos, held.take(column_of(col))[1] + " " + text, "joined"))
        else:
            ready.append((pos, text, "orphan" if kind == "continuation" else "complete"))
    return ready, held.left()


def stretches(halves: DataFrame) -> DataFrame:
    """halves (folder, pos, kind partial or continuation, ...) with `stretch`: parts of a folder that do not depend on
    each other, as nothing is open where one begins.

    How many halves are open does not depend on which ones are joined: it is S - M, with S the running count of partials
    less continuations and M the least S so far (0 at most). Both come from blocks, so a folder of any size is counted
    in many tasks.
    """
    order = ["pos", "kind"]
    step = F.when(F.col("kind") == "partial", 1).otherwise(-1).cast("long")
    rows = in_blocks(halves, ["folder"], order, "halves").withColumn("_s", F.sum(step).over(up_to(order)))
    of = rows.groupBy(GROUP, BLOCK).agg(F.sum(step).alias("t"), F.min("_s").alias("m"))
    base = before_block(of, base=F.sum("t")).withColumn("base", F.coalesce("base", F.lit(0)))
    low = before_block(of.join(base, [GROUP, BLOCK]).withColumn("m", F.col("base") + F.col("m")), low=F.min("m"))
    carried = base.join(low, [GROUP, BLOCK]).withColumn("low", F.least(F.lit(0), F.coalesce("low", F.lit(0))))
    rows = rows.join(carried, [GROUP, BLOCK])
    least = F.least(F.col("low"), F.col("base") + F.coalesce(F.min("_s").over(up_to(order, -1)), F.lit(0)))
    rows = rows.withColumn("_start", F.when(F.col("base") + F.col("_s") - step == least, F.col("pos")))
    starts = before_block(rows.groupBy(GROUP, BLOCK).agg(F.max("_start").alias("x")), earlier=F.max("x"))
    inside = F.max("_start").over(up_to(order))
    return rows.join(starts, [GROUP, BLOCK]).withColumn("stretch", F.coalesce(inside, "earlier")).drop(GROUP, BLOCK, "_s", "base", "low", "_start", "earlier")


def _joined(halves: DataFrame) -> DataFrame:
    """halves (folder, pos, text, col, kind) as folder, pos, text, state, head (pos of the partial that was taken).

    Stretches are dealt out to tasks and streamed in order; a task holds open halves only, however long a stretch is.
    """
    types = dict(halves.dtypes)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, Open()

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], names=["folder", "pos", "text", "state", "head"])

        def rest() -> list[tuple]:
            return [(key[0], p, t, "open", p) for p, t, _ in held.left()]

        for batch in batches:
            kinds, out = [batch.schema.field("folder").type, pa.int64(), pa.string(), pa.string(), pa.int64()], []
            for folder, stretch, pos, text, col, kind in zip(*(batch[c].to_pylist() for c in ("folder", "stretch", "pos", "text", "col", "kind"))):
                if key != (folder, stretch):
                    out += rest() if held.n else []
                    key, held = (folder, stretch), Open()
                if kind == "partial":
                    held.add(pos, text, column_of(col))
                elif held.n:
                    head, top = held.take(column_of(col))
                    out.append((folder, pos, f"{top} {text}", "joined", head))
                else:
                    out.append((folder, pos, text, "orphan", pos))
            yield rows(out)
        if held.n:
            yield rows(rest())

    few = halves.select("folder", F.col("pos").cast("long").alias("pos"), "text", F.col("col").cast("double").alias("col"), "kind")
    dealt = stretches(few).repartition("folder", "stretch").sortWithinPartitions("folder", "stretch", "pos", "kind")
    return dealt.mapInArrow(run, f"folder {types['folder']}, pos long, text string, state string, head long")


def with_carry(parts: DataFrame, carry: DataFrame | None) -> DataFrame:
    """parts (folder, pos, text, col) after the open halves of an earlier run (folder, pos, text, col, in order of pos),
    which are parts with positions before all others."""
    if carry is None:
        return parts
    types = dict(parts.dtypes)
    late = F.col("pos") - F.max("pos").over(W.partitionBy("folder")) - 1  # a folder's carry is its open halves, which are few
    shifted = carry.select(F.col("folder").cast(types["folder"]).alias("folder"), late.cast("long").alias("pos"), "text", F.col("col").cast("double").alias("col"))
    return shifted.unionByName(parts.select("folder", F.col("pos").cast("long").alias("pos"), "text", F.col("col").cast("double").alias("col")))


def stitch_by_column(parts: DataFrame) -> DataFrame:
    """parts (folder, pos, text, col, kind) joined by column: folder, pos, text, state as in stitch_in_order.

    Each continuation uses up the partial nearest by column, the first of equals; a null column is the middle. Only
    halves are shuffled, stretch by stretch. Empty tables give no rows; equal positions go by kind.
    """
    few = parts.select("folder", F.col("pos").cast("long").alias("pos"), "text", "col", "kind")
    whole = few.where("kind not in ('partial', 'continuation')").select("folder", "pos", "text", F.lit("complete").alias("state"))
    return _joined(few.where("kind in ('partial', 'continuation')")).drop("head").unionByName(whole)


def open_halves(parts: DataFrame) -> DataFrame:
    """What stitching parts (folder, pos, text, col) leaves open, with its column: the carry of a next run."""
    halves = classify(parts).where("kind in ('partial', 'continuation')")
    left = _joined(halves).where("state = 'open'").select(F.struct("folder", "pos").alias("_at"), "folder", "pos", "text")
    cols = parts.select(F.struct("folder", F.col("pos").cast("long").alias("pos")).alias("_at"), F.coalesce(F.nanvl(F.col("col").cast("double"), F.lit(MIDDLE)), F.lit(MIDDLE)).alias("col"))
    return left.join(cols, "_at").drop("_at")


def tied_parts(parts: DataFrame) -> DataFrame:
    """The parts (folder, pos, text, col) that go on with an earlier one, as _at, struct(folder, pos), with the pos of that
    one as group_pos. No text takes part in the stitching but its kind."""
    kinds = classify(parts.select("folder", F.col("pos").cast("long").alias("pos"), "text", "col")).select("folder", "pos", "col", "kind", F.lit("").alias("text"))
    return _joined(kinds.where("kind in ('partial', 'continuation')")).where("state = 'joined'").select(F.struct("folder", "pos").alias("_at"), F.col("head").alias("group_pos"))


def group_members(parts: DataFrame) -> DataFrame:
    """parts (folder, pos, text, col), blank ones included, with the group that each belongs to: the pos of its first
    part. Blank parts are groups of their own."""
    every = parts.select("folder", F.col("pos").cast("long").alias("pos"), F.struct("folder", F.col("pos").cast("long").alias("pos")).alias("_at"))
    return every.join(tied_parts(parts), "_at", "left").select("folder", "pos", F.coalesce("group_pos", "pos").alias("group_pos"))
