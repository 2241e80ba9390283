"""Best-fit packing: a configuration linear program over the length histogram, priced by knapsack, then rounded."""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exact_rank, keep, load, pieces, texts_only

CAPACITY = 2048
END_ID = 0
ROUNDS = 4
#: How often in a round a length may fail to find others that fill the rest.
TRIES = 4
#: Others are chosen by how many are left and by this power of their length, so that short ones remain for last gaps.
POWER = 12
#: Portions of the pieces that the rounded program may place.
PORTIONS = (1.0, 0.9, 0.4, 0.2, 0.1, 0.0)


#: White space that long is left to the tokenizers file: the fast encoder's pattern goes too deep there.
LONG_BLANK = re.compile(r"\s{2000}")


@lru_cache(2)
def encoder(name: str = "byte_bpe_50k") -> Callable[..., np.ndarray]:
    """Ids of the public vocabulary; its rank file gives the same ids as the tokenizers file, several times as fast.

    Texts with very long white space go through the tokenizers file itself.
    """
    import public_tokenizers
    import tiktoken

    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(name), special_tokens={})

    def encode(text: str, tidy: bool = False) -> np.ndarray:
        """tidy: the text has no two white-space characters of ASCII beside each other."""
        if len(text) > 2000 and not (tidy and text.isascii()) and LONG_BLANK.search(text):
            return np.array(slow_encoder(name).encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=())

    return encode


@lru_cache(2)
def slow_encoder(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    slow.encode_special_tokens = True  # their strings in a text are ordinary text
    return slow


def ranks(name: str) -> dict[bytes, int]:
    import public_tokenizers

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def vocabulary(name: str = "byte_bpe_50k") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids one after the other, and where each begins; the id after the last has none."""
    order = sorted((i, b) for b, i in ranks(name).items())
    starts = np.cumsum([0, *(len(b) for _, b in order)])
    return np.frombuffer(b"".join(b for _, b in order), np.uint8), np.append(starts, starts[-1])


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and END_ID, cut from the end into full pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name)
        for batch in pieces(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = np.append(encode(text), np.uint32(END_ID)).astype("<u4").tobytes()
                n = len(ids) // 4
                at = 0
                for k in range(-(-n // capacity)):
                    to = at + ((n - 1) % capacity + 1 if k == 0 else capacity)
                    rows.append((doc, k, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                    at = to
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, zip(*rows))], names=names)

    return texts_only(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def price(lengths: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack: the best value within each capacity."""
    best = np.zeros(capacity + 1)
    fit = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fit[c]:
            best[c] = max(best[c], (best[c - lengths[:k]] + value[:k]).max())
    return best


def fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS, near: float = 3e-3, rate: float = 1e-3, seed: int = 5) -> dict[tuple[int, ...], float]:
    """Configurations with their shares: multiplicative weights on the lengths, each round priced by one knapsack.

    A round may use what of the demand so far is not covered. From each length, longest first, it builds
    configurations out of lengths that the knapsack prices within `near` of the best, at random by what is left of
    them, until none is left or none fits so well. Lengths that lag behind get dearer, others cheaper.
    """
    value, n = lengths / capacity, len(lengths)
    covered, x = np.zeros(n), defaultdict(float)
    rng = np.random.Generator(np.random.PCG64(seed))
    for t in range(rounds):
        best = price(lengths, value, capacity)
        left = demand * (t + 1) / rounds - covered
        there = np.zeros(capacity + 1, bool)  # what a single length, or nothing, fills
        there[lengths], there[0] = left > 1e-9, True
        slack = near * best[capacity]
        for i in range(n - 1, -1, -1):
            tries = TRIES
            while left[i] > 1e-9 and tries:
                config, room, used = [i], capacity - int(lengths[i]), {i: 1}
                fits = best[capacity] - best[room] - value[i] <= slack
                while fits and room:
                    k = int(np.searchsorted(lengths, room, "right"))
                    good = np.flatnonzero((best[room - lengths[:k]] + value[:k] >= best[room] - slack) & (left[:k] > 1e-9))
                    if not len(good):
                        fits = best[room] <= slack
                        break
                    last = good[there[room - lengths[good]]]
                    good = last if len(last) else good
                    weight = np.cumsum(left[good] * lengths[good].astype(float) ** POWER)
                    j = int(good[min(len(good) - 1, np.searchsorted(weight, rng.random() * weight[-1], "right"))])
                    config.append(j)
                    used[j] = used.get(j, 0) + 1
                    room -= int(lengths[j])
                if not fits:
                    tries -= 1
                    continue
                share = min(left[j] / m for j, m in used.items())
                x[tuple(sorted(config))] += share
                for j, m in used.items():
                    left[j] -= m * share
                    covered[j] += m * share
                    there[lengths[j]] = left[j] > 1e-9
        value = value * np.exp(rate * np.clip((left / demand) * rounds, -4, 4))
        value *= (lengths / capacity).sum() / value.sum()
    return x


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Best-fit decreasing over a histogram: (number of sequences, ((length, count), ...)), many alike at a time."""
    room: dict[int, list[list]] = defaultdict(list)  # by what is left: [number of sequences, content]
    free = np.zeros(capacity + 1, np.int64)
    free[capacity] = 1 << 62
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            r = length + int(np.argmax(free[length:] > 0))
            if r == capacity:
                n, content = left, ()
            else:
                n, content = room[r][-1]
            each = min(r // length, left)
            m = min(n, left // each)
            if r != capacity:
                free[r] -= m
                room[r][-1][0] -= m
                if not room[r][-1][0]:
                    room[r].pop()
            rest = r - each * length
            room[rest].append([m, (*content, (length, each))])
            free[rest] += m if rest else 0
            left -= m * each
    return [(n, content) for groups in room.values() for n, content in groups if n]


def rounded(demand: np.ndarray, x: dict[tuple[int, ...], float], portion: float) -> list[tuple[int, dict[int, int]]]:
    """Whole numbers of the configurations, for about this portion of all pieces: (number, {length number: count}).

    Those with the longest pieces come first, as these are the hardest to place. Each is used as often as its share
    says and its own lengths last; what is cut off from a share goes to the next one.
    """
    out, left, due, room = [], demand.copy(), 0.0, portion * demand.sum()
    for c in sorted(x, reverse=True, key=lambda c: c[::-1]):
        i, a = np.unique(np.array(c), return_counts=True)
        due += x[c]
        n = min(int(due + 1e-6), int((left[i] // a).min()), int(room // a.sum()))
        if n:
            due -= n
            left[i] -= n * a
            room -= n * int(a.sum())
            out.append((n, dict(zip(i.tolist(), a.tolist()))))
    return out


def configurations(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Sequences that hold exactly the pieces of the histogram: the rounded program, then best fit for the rest.

    Rounding leaves odd pieces together, which fit badly by themselves. So the program is rounded for several
    portions of the pieces, best fit places the others, and what needs the fewest sequences is taken; among equals
    that with the largest portion. Best fit alone is the last resort.
    """
    out = [(n, ((capacity, 1),)) for n in [histogram.get(capacity, 0)] if n]
    lengths = np.array(sorted(x for x, n in histogram.items() if n and x < capacity), np.int64)
    if not len(lengths):
        return out
    demand = np.array([histogram[int(x)] for x in lengths], np.int64)
    x = fractional(lengths, demand.astype(float), capacity, rounds)
    least, best = -(-int((lengths * demand).sum()) // capacity), None
    for portion in PORTIONS:
        left, way = demand.copy(), []
        for n, content in rounded(demand, x, portion):
            way.append((n, tuple((int(lengths[i]), k) for i, k in content.items())))
            for i, k in content.items():
                left[i] -= n * k
        way += best_fit({int(v): int(n) for v, n in zip(lengths, left) if n}, capacity)
        size = sum(n for n, _ in way)
        if best is None or size < best[0]:
            best = size, way
        if size == least:
            break
    return out + best[1]


def pack(pieces_: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces_ with sequence_id long and offset long.

    The histogram (at most `capacity` rows) comes to the driver and the configurations go to the tasks, as many
    at most as rounds times lengths. Each piece finds its place from its rank among those of its length.
    """
    histogram = {r.length: r.n for r in pieces_.groupBy("length").agg(F.count("*").alias("n")).collect()}
    base, places = 0, defaultdict(list)  # by length: first rank, sequences, first sequence, count in each, offset in it
    ranks: dict[int, int] = defaultdict(int)
    for n, content in configurations(histogram, capacity):
        at = 0
        for length, each in content:
            places[length].append((ranks[length], base, each, at))
            ranks[length] += n * each
            at += length * each
        base += n
    table = {k: np.array(v, np.int64).T for k, v in places.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch["length"]), np.asarray(batch["rank"])
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                size = int(length[rows[0]])
                first, seq, each, at = table[size]
                k = np.searchsorted(first, rank[rows], "right") - 1
                q, i = np.divmod(rank[rows] - first[k], each[k])
                sequence[rows], offset[rows] = seq[k] + q, at[k] + i * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    key = [F.col(c) for c in ("doc_id", "piece", "ids_crc32")]
    ranked = exact_rank(pieces_, ["length"], key, F.struct(*key), name="rank", rows=sum(histogram.values()))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of each document: where its ids stand in sequences of at most `capacity` ids.

    Null and empty texts have the end id alone. Documents are cut only if longer than a sequence: into full pieces
    from the end, after a shorter first one. Repeated rows are packed as often as they occur.
    """
    return pack(keep(token_pieces(docs, capacity), "pieces"), capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(load(spark, sf_dir, "documents"))
