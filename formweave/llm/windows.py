"""Order-preserving packing: windows of successive ids, cut where padding and truncation together cost least."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import load, pieces, text_bytes, texts_only
from .packing import ranks, slow_encoder, vocabulary

CAPACITY = 2048
END_ID = 1
#: What a cut costs, in ids of padding: between documents nothing, at the end of a sentence, and elsewhere.
SENTENCE, INSIDE = 8, 128
#: Stretches of more ids without the end of a sentence may be cut before any word, those without words anywhere. In a
#: shorter one a cut costs more than moving it to the end would, but where a window gets a power of two by it.
LONG = INSIDE
#: Bytes of text for which the windows are sought at once.
CHUNK = 1 << 20
STOPS, CLOSERS, BLANKS = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b".!?", b"\"')]", b" \t\n\x0b\x0c\r"))
MAY_END, WIDE_STOPS = STOPS | CLOSERS, ("\u3002".encode(), "\uff01".encode(), "\uff1f".encode())


@lru_cache(2)
def plain_encoder(name: str = "byte_bpe_50k") -> Callable[[str], np.ndarray]:
    """The ids that packing.encoder() gives, without its search for special tokens, which no text here has."""
    import public_tokenizers
    import tiktoken

    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(name), special_tokens={})

    def encode(text: str) -> np.ndarray:
        # White space of 2000 characters, which the fast pattern cannot take, fills one of these blocks at least.
        if len(text) >= 2000 and any(text[i : i + 1000].isspace() for i in range(0, len(text), 1000)):
            return np.array(slow_encoder(name).encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode


def sentence_ends(data: bytes) -> np.ndarray:
    """Offsets behind sentences: after full stops, marks and what closes quotes behind them if a blank follows, after
    ideographic ones, and after line ends."""
    raw = np.frombuffer(data, np.uint8)
    last = MAY_END[raw]
    last[:-1] &= BLANKS[raw[1:]]
    at = np.flatnonzero(last)
    closed = CLOSERS[raw[at]]
    if closed.any():  # what closes counts if a stop stands before all of it
        others = np.flatnonzero(~CLOSERS[raw])
        before = np.searchsorted(others, at[closed]) - 1
        good = np.ones(len(at), bool)
        good[closed] = (before >= 0) & STOPS[raw[others[before]]] if len(others) else False
        at = at[good]
    parts = [at, np.flatnonzero(raw == 10)]
    if any(mark in data for mark in WIDE_STOPS) and len(raw) > 2:
        for a, b, c in WIDE_STOPS:
            parts.append(np.flatnonzero((raw[:-2] == a) & (raw[1:-1] == b) & (raw[2:] == c)) + 2)
    return np.unique(np.concatenate(parts)) + 1


def places_to_cut(ids: list[np.ndarray], data: bytes, long: int = LONG, sentence: int = SENTENCE, inside: int = INSIDE) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end, as numbers of ids (with one more id at the end of each document), and what it costs.

    ids: those of each document without the last; data: all texts one after the other.
    """
    body, starts = vocabulary()
    size = np.array([len(x) for x in ids], np.int64)
    every = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int64)
    ends = np.cumsum(starts[every + 1] - starts[every])  # in bytes
    closes = np.cumsum(size + 1)  # behind the last id of each document
    total = int(closes[-1]) if len(closes) else 0
    cost = np.full(total + 1, -1, np.int32)
    number = np.arange(1, len(every) + 1) + np.repeat(np.arange(len(size)), size)  # ids up to each, last ones counted
    blank = BLANKS[body[starts[every]]]
    where = np.searchsorted(ends, found := sentence_ends(data))
    where = where[(where < len(ends)) & (ends[np.minimum(where, len(ends) - 1)] == found)] if len(ends) else where[:0]
    cost[number[where]] = sentence
    cost[closes - 1] = -1  # the last id alone is no sentence
    cost[closes] = 0
    for before in (blank, np.ones(len(every), bool)):  # words, then any ids
        cuts = np.concatenate(([0], np.flatnonzero(cost >= 0)))
        gap = np.diff(cuts)
        if not (gap > long).any():
            break
        wide = np.zeros(total + 1, bool)
        wide[1:] = np.repeat(gap > long, gap)
        more = number[before] - 1  # ids before the word
        more = more[wide[more] & (cost[more] < 0)]
        cost[more] = inside
        cost[closes - 1] = np.where(cost[closes - 1] == inside, -1, cost[closes - 1])
    out = np.flatnonzero(cost >= 0)
    return out, cost[out]


class Windows:
    """Cheapest ends of windows over a stream of places to cut, by dynamic programming.

    The least cost up to a place is that of the cut there plus the least, over places at most `capacity` ids before, of
    their cost and the padding in between. That is a minimum over a sliding window, so a queue of places with rising
    costs gives it; windows whose length is a power of two need no padding and are tried besides. What all places that
    later ones may still build on have in common is settled, so only the last few windows are held.
    """

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        self.pos, self.cost, self.back = [0], [0], [0]
        self.queue: deque[int] = deque([0])

    def feed(self, places: np.ndarray, penalties: np.ndarray) -> None:
        """Places later than all so far, none more than `capacity` after the one before."""
        if not len(places):
            return
        pos, cost, back, queue, cap = self.pos, self.cost, self.back, self.queue, self.capacity
        known, n = np.array(pos, np.int64), len(pos)
        low = max(int(known[0]), int(places[0]) - cap)
        index = np.full(int(places[-1]) - low + 1, -1, np.int64)
        recent = known >= low
        index[known[recent] - low] = np.flatnonzero(recent)
        index[places - low] = np.arange(n, n + len(places))
        exact = []  # (place, predecessor) for each window that needs no padding
        for k in range(cap.bit_length()):
            p = places - low - (1 << k)
            i = index[np.maximum(p, 0)]
            good = np.flatnonzero((p >= 0) & (i >= 0))
            exact.append(np.stack([good + n, i[good]]))
        exact = np.concatenate(exact, axis=1)
        exact = exact[:, np.argsort(exact[0], kind="stable")]
        at, of = [*exact[0].tolist(), -1], exact[1].tolist()
        key = [p + c for p, c in zip(pos, cost)]
        e = 0
        for j, (p, more) in enumerate(zip(places.tolist(), penalties.tolist()), n):
            while pos[queue[0]] < p - cap:
                queue.popleft()
            i = queue[0]
            best = key[i] + cap - p
            while at[e] == j:
                if cost[of[e]] < best:
                    i, best = of[e], cost[of[e]]
                e += 1
            best += more
            pos.append(p)
            cost.append(best)
            back.append(i)
            key.append(best := best + p)
            while queue and key[queue[-1]] > best:
                queue.pop()
            queue.append(j)

    def settled(self, end: bool = False) -> list[int]:
        """Ends of windows that no later place can change (at the end of the stream: all), from the last one given on."""
        pos, back = self.pos, self.back
        if end:
            last = len(pos) - 1
        else:
            first = next(i for i in range(len(pos) - 1, -1, -1) if i == 0 or pos[i - 1] < pos[-1] - self.capacity)
            open_ = set(range(first, len(pos)))
            while len(open_) > 1:
                x = max(open_)
                open_.remove(x)
                open_.add(back[x])
            last = open_.pop()
        out, i = [], last
        while i:
            out.append(pos[i])
            i = back[i]
        base = self.cost[last]
        self.pos, self.cost, self.back = pos[last:], [c - base for c in self.cost[last:]], [max(0, i - last) for i in back[last:]]
        self.queue = deque(i - last for i in self.queue if i >= last)
        return out[::-1]


def _pieces_of(ends: list[int], begin: int, docs: list[tuple], first_sequence: int) -> list[tuple]:
    """Rows for the windows from `begin` on with these ends; docs: (doc_id, place of the first id, bytes of ids)."""
    rows, k, a, sequence = [], 0, begin, first_sequence
    for end in ends:
        x = a
        while x < end:
            doc, first, ids = docs[k]
            close = first + len(ids) // 4
            if close <= x:
                k += 1
                continue
            y = min(end, close)
            rows.append((doc, x - first, y - x, zlib.crc32(ids[4 * (x - first) : 4 * (y - first)]), len(ids) // 4, sequence, x - a))
            x = y
        a, sequence = end, sequence + 1
    return rows


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def order_preserving_packing(docs: DataFrame, order: list[str] | None = None, capacity: int = CAPACITY, name: str = "byte_bpe_50k", chunk: int = CHUNK) -> DataFrame:
    """One row for each piece of each document: where its ids and END_ID stand in sequences of at most `capacity` ids.

    Sequences are windows over the documents in the order in which their partitions hold them (with `order`: in that of
    these columns, over range partitions), so a partition is packed by itself in one pass, nothing is shuffled, and a
    lost task gives the same rows again. Windows end with a document for nothing, else with a sentence or, in long
    stretches without one, before a word or any id, so that padding and penalties are least; a sequence whose length is
    a power of two has no padding. Null and empty texts have the end id alone; a text of any length is cut wherever
    windows end; repeated rows are packed as often as they occur; an empty table gives no rows. A null doc_id stays
    null. Other columns are not read, but for those of `order`.
    """
    if order:
        docs = docs.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, windows, held, begin, upto = plain_encoder(name), Windows(capacity), deque(), 0, 0
        sequence = TaskContext.get().partitionId() << 40

        def rows(ends: list[int]) -> Iterator[pa.RecordBatch]:
            nonlocal begin, sequence
            out = _pieces_of(ends, begin, list(held), sequence)
            if ends:
                begin, sequence = ends[-1], sequence + len(ends)
                while held and held[0][1] + len(held[0][2]) // 4 <= begin:
                    held.popleft()
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=NAMES)

        for batch in pieces(batches, limit=chunk):
            ids = [encode(t) for t in batch["text"].to_pylist()]
            for doc, x in zip(batch["doc_id"].to_pylist(), ids):
                at = held[-1][1] + len(held[-1][2]) // 4 if held else begin
                held.append((doc, at, np.append(x, np.uint32(END_ID)).astype("<u4").tobytes()))
            places, cost = places_to_cut(ids, text_bytes(batch)[0], min(LONG, max(1, capacity // 2 - 1)))
            windows.feed(places + upto, cost)
            upto += int(places[-1])
            yield from rows(windows.settled())
        yield from rows(windows.settled(end=True))

    return texts_only(docs).mapInArrow(run, SCHEMA)


def op13_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of at most 2048 ids, in order."""
    return order_preserving_packing(load(spark, sf_dir, "documents"))
