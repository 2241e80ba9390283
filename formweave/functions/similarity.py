"""String similarity and differences: small kernels in tasks, fed by Arrow."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Glyphs that the display treats as alike, and characters that are never shown as different.
SHOWN_ALIKE = str.maketrans("L|O", "II0")
NEVER_DIFFERENT = set(" \t\n\r-,_")


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & places.get(ch, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    """100 times twice the common subsequence over both lengths; two empty strings are alike."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] numbers), then those from starts[1] on, and so forth."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def window_ratios(forms: list[tuple[list[str], list[str]]], longest: list[list[int]]) -> list[list[np.ndarray]]:
    """For each form (values, words) and value x a table t: t[n, e] is the ratio of x and the n words before e, joined
    by a space, up to its `longest` n; -inf where there are none.

    All windows of all forms that begin at one word are followed at once, a character a step, with one machine word
    for each row of the matrix; where a word ends, the row tells the common length of the window so far. Values too
    long for that go one by one.
    """
    form = np.repeat(np.arange(len(forms)), [len(asked) for asked, _ in forms])
    asked = [x for values, _ in forms for x in values]
    m = np.array([len(words) for _, words in forms], np.int64)
    most, wide = np.fromiter(chain.from_iterable(longest), np.int64, len(asked)), m[form] + 1
    base = np.concatenate(([0], np.cumsum((most + 1) * wide)))
    flat = np.full(int(base[-1]), -np.inf)
    flat[ragged(base[:-1], wide)] = np.repeat(np.array([0.0 if x else 100.0 for x in asked]), wide)
    one = (flat[s:e].reshape(-1, w) for s, e, w in zip(base[:-1].tolist(), base[1:].tolist(), wide.tolist()))
    tables = [list(islice(one, len(values))) for values, _ in forms]
    values, value_of = {}, np.full(len(asked), -1, np.int64)
    for q, x in enumerate(asked):
        if len(x) > 64:
            words, table = forms[form[q]][1], flat[base[q] : base[q + 1]].reshape(-1, wide[q])
            for k in range(1, min(len(table), len(words) + 1)):
                table[k, k:] = [ratio(x, " ".join(words[e - k : e])) for e in range(k, len(words) + 1)]
        else:
            value_of[q] = values.setdefault(x, len(values))
    short = np.flatnonzero(value_of >= 0)
    # a slot is a value and a word at which windows begin
    slot = np.repeat(short, m[form[short]])
    if not len(slot):
        return tables
    word = ragged(np.zeros(len(short), np.int64), m[form[short]])
    every = [w for _, words in forms for w in words]
    begin = np.concatenate(([0], np.cumsum(np.fromiter(map(len, every), np.int64, len(every)) + 1)))
    first = (np.cumsum(m) - m)[form[slot]]
    starts, ends = begin[first + word], begin[first + np.minimum(m[form[slot]], word + most[slot])] - 1
    points = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters, codes = np.unique(points(" ".join([*every, ""])), return_inverse=True)
    word_no = np.zeros(len(codes), np.int64)  # where a word ends, its number in the form from 1
    word_no[begin[1:] - 2] = ragged(np.ones(len(m), np.int64), m)
    size = np.fromiter(map(len, values), np.int64, len(values))
    cp = points("".join(values))
    c = np.minimum(np.searchsorted(letters, cp), len(letters) - 1)
    masks, same = np.zeros(len(values) * len(letters), np.uint64), letters[c] == cp
    bits = np.uint64(1) << ragged(np.zeros(len(size), np.int64), size).astype(np.uint64)
    np.bitwise_or.at(masks, (np.repeat(np.arange(len(size)) * len(letters), size) + c)[same], bits[same])
    full = np.array([(1 << n) - 1 for n in size.tolist()], np.uint64)
    order = np.argsort(starts - ends, kind="stable")  # longest first, so that those still going are the first ones
    slot, word, starts, ends = slot[order], word[order], starts[order], ends[order]
    own = value_of[slot]
    row_of, full, size = own * len(letters), full[own], size[own]
    going = np.searchsorted(starts - ends, -np.arange(int((ends - starts).max(initial=0))), "left")
    row = np.full(len(order), ~np.uint64(0))
    place = base[slot] - word * wide[slot]  # where in `flat` the window of no words would end before the form
    for j, n in enumerate(going.tolist()):
        at = starts[:n] + j
        v = row[:n]
        u = v & masks[row_of[:n] + codes[at]]
        row[:n] = (v + u) | (v - u)
        e = word_no[at]
        done = np.flatnonzero(e)
        if len(done):
            e = e[done]
            common = size[done] - np.bitwise_count(row[done] & full[done])
            flat[place[done] + e * wide[slot[done]] + e] = 200.0 * common / (size[done] + j + 1)
    return tables


def ratios(left: pa.Array, right: pa.Array) -> pa.Array:
    """ratio() of the strings of two arrays; null where either is."""
    same = pc.equal(left, right)  # null where either is
    some = np.flatnonzero(np.asarray(pc.fill_null(pc.invert(same), False)))  # only what differs is compared
    values = np.full(len(left), 100.0)
    values[some] = [ratio(a, b) for a, b in zip(left.take(pa.array(some)).to_pylist(), right.take(pa.array(some)).to_pylist())]
    return pa.array(values, mask=np.asarray(same.is_null()))


def with_ratio(df: DataFrame, left: str, right: str, name: str = "ratio") -> DataFrame:
    """df with the ratio of two string columns (null where either is null), for strings of any length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, ratios(batch[left], batch[right])], names=[*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def with_ratios(df: DataFrame, left: str, right: str, name: str = "ratios") -> DataFrame:
    """with_ratio() of two columns of arrays of strings, of one size in each row: an array of ratios."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pa.ListArray.from_arrays(pc.cast(offsets(batch[left]), pa.int32()), ratios(batch[left].flatten(), batch[right].flatten()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def offsets(lists: pa.Array) -> pa.Array:
    """Where each list begins among all values of lists that are not null, and where the last one ends."""
    return pa.array(np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)))))


def differences(expected: str, found: str) -> list[dict]:
    """Runs of `found`, in order, and whether each differs from what was expected. Separators never do."""
    fold = lambda s: s.upper().translate(SHOWN_ALIKE) if len(s.upper()) == len(s) else s
    a, b = fold(expected), fold(found)
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in reversed(range(n)):
        for j in reversed(range(m)):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    same, i, j = [False] * m, 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            same[j] = True
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    out: list[dict] = []
    for ch, ok in zip(found, same):
        differs = not ok and ch not in NEVER_DIFFERENT
        if out and out[-1]["diff"] == differs:
            out[-1]["text"] += ch
        else:
            out.append({"text": ch, "diff": differs})
    return out


def with_differences(df: DataFrame, expected: str, found: str, name: str = "segments") -> DataFrame:
    """df with array<struct<text, diff>>: the characters of `found`, marked where they differ from `expected`."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("diff", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [differences(a or "", b or "") for a, b in zip(batch[expected].to_pylist(), batch[found].to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, kind)], names=[*batch.schema.names, name])

    kind_ = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("diff", T.BooleanType())]))
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, kind_)]))
