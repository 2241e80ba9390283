"""Stitching over a stream: open halves of forms are state of their folder until they are joined, flushed or carried on.

A stream may begin with the open halves of an earlier run (its carry) and leave its own to the next one, as a request
gets the pending halves of the request before and gives back what it leaves pending.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from formweave.operators.stitch import MIDDLE, by_column, classify, column_of

OUTPUT = "folder string, pos long, text string, state string"
STATE = "pos long, text string, col double"
CARRY = f"folder string, {STATE}"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normal_carry(carried: list) -> list[tuple[int, str, float]]:
    """Open halves that an earlier run passed on: texts, or pairs of text and column; the middle where none is known."""
    out = []
    for i, x in enumerate(carried):
        text, col = (x, None) if isinstance(x, str) else (x[0], x[1] if len(x) > 1 else None)
        out.append((i - len(carried), text, MIDDLE if col is None else col))
    return out


def carry_table(spark: SparkSession, carried: dict[str, list]) -> DataFrame:
    """Carries by folder, each a list as normal_carry() takes it, as a table."""
    return spark.createDataFrame([(folder, *x) for folder, some in carried.items() for x in normal_carry(some)], CARRY)


class Stitcher(StatefulProcessor):
    """Holds the open halves of one folder as a list state, in order of arrival."""

    def __init__(self, timeout_ms: int | None = None) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getListState("open", STATE)

    def held(self) -> list[tuple[int, str, float]]:
        return [tuple(x) for x in self.open.get()] if self.open.exists() else []

    def hold(self, held: list[tuple[int, str, float]], now_ms: int | None = None) -> None:
        self.open.put(held) if held else self.open.clear()
        if self.timeout_ms and now_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if held:
                self.handle.registerTimer(now_ms + self.timeout_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        some = initialState.sort_values("pos")
        n = len(some)  # before all positions of the stream, in their own order
        now = timerValues.getCurrentProcessingTimeInMs() if self.timeout_ms else None
        self.hold([(i - n, text, column_of(col)) for i, (text, col) in enumerate(zip(some["text"], some["col"].tolist()))], now)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, ready, batch = self.held(), [], []
        some = pd.concat(list(rows)).sort_values("pos", kind="stable")
        for row in zip(some["pos"].tolist(), some["text"], some["col"].tolist(), some["kind"]):
            if row[3] == "flush":
                done, held = by_column(batch, held)
                ready += done + [(p, t, "open") for p, t, _ in held]
                held, batch = [], []
            else:
                batch.append(row)
        done, held = by_column(batch, held)
        self.hold(held, timerValues.getCurrentProcessingTimeInMs() if self.timeout_ms else None)
        yield self.rows(key, ready + done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.held()
        self.open.clear()
        yield self.rows(key, [(p, t, "open") for p, t, _ in held])

    def rows(self, key, ready: list[tuple[int, str, str]]) -> pd.DataFrame:
        text = lambda v: pd.Series(v, dtype=object)  # noqa: E731  (other string columns do not go back to Arrow here)
        return pd.DataFrame({"folder": text([key[0]] * len(ready)), "pos": pd.Series([r[0] for r in ready], dtype="int64"), "text": text([r[1] for r in ready]), "state": text([r[2] for r in ready])})

    def close(self) -> None:
        pass


def stitch_stream(parts: DataFrame, carry: DataFrame | None = None, timeout_ms: int | None = None) -> DataFrame:
    """A stream of parts (folder, pos, text, col) joined by column: folder, pos, text, state.

    The state of a folder is its open halves, so it stays as small as these, and the result does not depend on how
    the stream is cut into batches. `carry` (folder, pos, text, col) has halves that are open before the first batch;
    folders that only it names stay in state until they get rows or time out. A row with a null text (an end mark)
    flushes its folder: what is open goes out as it is. With a timeout, folders that stay silent for so long are flushed
    too. What is still open when the stream stops is left_open(). State is kept by RocksDB, which this sets unless the
    session names another store.
    """
    spark = parts.sparkSession
    if spark.conf.get(PROVIDER).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKSDB)
    kinds = classify(parts.where("text is not null")).select("folder", "pos", "text", "col", "kind")
    ends = parts.where("text is null").select("folder", "pos", "text", "col", F.lit("flush").alias("kind"))
    few = kinds.unionByName(ends).select(F.col("folder").cast("string").alias("folder"), F.col("pos").cast("long").alias("pos"), "text", F.col("col").cast("double").alias("col"), "kind")
    first = None if carry is None else carry.select(F.col("folder").cast("string").alias("folder"), F.col("pos").cast("long").alias("pos"), "text", F.col("col").cast("double").alias("col")).groupBy("folder")
    return few.groupBy("folder").transformWithStateInPandas(Stitcher(timeout_ms), OUTPUT, "append", "ProcessingTime" if timeout_ms else "None", first)


def left_open(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The carry (folder, pos, text, col) that a stopped stream leaves in its checkpoint, read as a table of its state."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "open").load()
    return state.select(F.col("key.folder").alias("folder"), "list_element.pos", "list_element.text", "list_element.col")
