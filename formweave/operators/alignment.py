"""Ordered sequence operators: which words of a scanned form belong to which field."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formweave.catalog import FIELDS
from formweave.functions.scoring import field_score
from formweave.functions.similarity import window_ratios
from formweave.functions.text import collapse, tokens

# Words that a value may take beyond its own number when it is located, and similarities that recover a lost one.
SLACK = 4
RECOVER_ONE, RECOVER_MORE = 40.0, 55.0
LOCATED = [f for f in FIELDS if f[3]]
#: Forms that are aligned together.
AT_ONCE = 256
#: Places of tables of forms whose chains are found together.
CELLS = 1 << 20
#: Known values that a kernel may hold; more are refused rather than sent to every task.
MOST_LISTED = 100_000


def best_chain(tables: list[np.ndarray], skip: bool) -> list[tuple[int, int]]:
    """Ordered runs (begin, end) with the best total: tables[i][n, e] is what field i gains from the n words before e.

    With skip, words between fields may be left out; otherwise the runs cover all words, or are all empty where
    that cannot be. Of equal totals the shortest run, the earliest place before it and the first end win.
    """
    return best_chains([t[None] for t in tables], skip)[0]


def best_chains(tables: list[np.ndarray], skip: bool) -> list[list[tuple[int, int]]]:
    """best_chain() of many forms: tables[i][form, n, e], with -inf beyond a form's own words (then only with skip)."""
    forms, m = len(tables[0]), tables[0].shape[2] - 1
    each, places = np.arange(forms)[:, None], np.arange(m + 1)
    total = np.zeros((forms, m + 1)) if skip else np.broadcast_to(np.where(places == 0, 0.0, -np.inf), (forms, m + 1))
    steps = []
    for gain in tables:
        before, at = total, np.broadcast_to(places, total.shape)
        if skip:
            before = np.maximum.accumulate(total, axis=1)
            at = np.zeros(total.shape, np.int64)
            at[:, 1:] = np.where(total[:, 1:] > before[:, :-1], places[1:], 0)
            at = np.maximum.accumulate(at, axis=1)
        options = np.full(gain.shape, -np.inf)
        for n in range(min(gain.shape[1], m + 1)):
            np.add(before[:, : m + 1 - n], gain[:, n, n:], out=options[:, n, n:])
        length = options.argmax(axis=1)
        steps.append((length, at))
        total = options[each, length, places]
    each = each[:, 0]
    end = total.argmax(axis=1) if skip else np.full(forms, m)
    runs = []
    for length, at in reversed(steps):
        begin = end - length[each, end]
        runs.append(list(zip(begin.tolist(), end.tolist())))
        end = at[each, begin]
    return [list(of) for of in zip(*reversed(runs))]


def align(expected: list[str], words: list[str]) -> list[tuple[int, int]]:
    """The run of words that each expected value most likely is, in order; (n, n) where none was found."""
    return align_all([(expected, words)])[0]


def align_all(forms: list[tuple[list[str], list[str]]]) -> list[list[tuple[int, int]]]:
    """align() of many forms at once."""
    sizes = [[max(1, len(x.split())) for x in expected] for expected, _ in forms]
    tables = window_ratios(forms, [[n + SLACK for n in of] for of in sizes])
    like: dict[tuple[int, int], list[int]] = {}  # forms of as many fields and about as many words
    for f, (expected, words) in enumerate(forms):
        if expected:
            like.setdefault((len(expected), len(words).bit_length()), []).append(f)
    out: list[list[tuple[int, int]]] = [[] for _ in forms]
    for (n, _), same in like.items():
        shape = max(max(sizes[f]) for f in same) + SLACK + 1, max(len(forms[f][1]) for f in same) + 1
        step = max(1, CELLS // (n * shape[0] * shape[1]))
        for some in (same[i : i + step] for i in range(0, len(same), step)):
            stacked = [np.full((len(some), *shape), -np.inf) for _ in range(n)]
            for j, f in enumerate(some):
                for stack, t in zip(stacked, tables[f]):
                    stack[j, : t.shape[0], : t.shape[1]] = t
            for f, runs in zip(some, best_chains(stacked, skip=True)):
                out[f] = located(runs, tables[f], sizes[f], len(forms[f][1]))
    return out


def located(runs: list[tuple[int, int]], tables: list[np.ndarray], sizes: list[int], m: int) -> list[tuple[int, int]]:
    """The runs of best_chain(), and words for values left without any where some between their neighbours are alike."""
    if all(e > b for b, e in runs):
        return runs
    taken = np.zeros(m + 1, bool)
    for b, e in runs:
        taken[b:e] = True
    for i, (b, e) in enumerate(runs):  # values left without words look for some between their neighbours
        if e > b:
            continue
        low = runs[i - 1][1] if i else 0
        high = next((b2 for b2, e2 in runs[i + 1 :] if e2 > b2), m)
        tries = [(float(tables[i][k, s + k]), -s, -k) for s in range(low, high) for k in range(1, sizes[i] + 2) if s + k <= high and not taken[s : s + k].any()]
        if tries:
            score, s, k = max(tries)
            if score >= (RECOVER_ONE if sizes[i] <= 1 else RECOVER_MORE):
                runs[i] = (-s, -s - k)
                taken[-s : -s - k] = True
    return runs


def align_forms(forms: DataFrame, expected: Column, text: Column, keys: list[str]) -> DataFrame:
    """forms with spans: array of struct(field, begin, end, found) for an array of expected values in form order.

    Blank values are not located (no span). Words are compared without case and accents; found has them as they
    stand in the text. Each form is aligned by itself, in time that grows with its words, so forms of any number
    spread over tasks.
    """
    # A form takes far longer than its bytes tell, so forms are dealt to all tasks, however few files they came from.
    dealt = forms.repartition(int(forms.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = dealt.withColumns({
        "_values": F.transform(F.coalesce(expected, F.array().cast("array<string>")), lambda v: collapse(F.coalesce(v, F.lit("")))),
        "_words": tokens(collapse(F.coalesce(text, F.lit("")))),
        "_shown": tokens(F.coalesce(text, F.lit(""))),
    })
    columns = forms.columns
    kind = pa.list_(pa.struct([("field", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("found", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, AT_ONCE) for i in range(0, batch.num_rows, AT_ONCE)):
                some = [[(k, v) for k, v in zip(keys, values) if v] for values in part["_values"].to_pylist()]
                spans = align_all([([v for _, v in fields], words) for fields, words in zip(some, part["_words"].to_pylist())])
                out = [[(k, b, e, " ".join(shown[b:e])) for (k, _), (b, e) in zip(*both)] for *both, shown in zip(some, spans, part["_shown"].to_pylist())]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in columns), pa.array(out, kind)], names=[*columns, "spans"])

    span = T.StructType([T.StructField("field", T.StringType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("found", T.StringType())])
    return rows.mapInArrow(run, T.StructType([*forms.schema.fields, T.StructField("spans", T.ArrayType(span))]))


def segment(words: list[str], listed: dict[str, frozenset[str]] | None = None, cells: list[list[str]] | None = None) -> tuple[list[tuple[int, int]], bool]:
    """Runs of words for all located fields that cover the whole text, by content alone; and whether that is possible.

    With cells (the words of each, in order) a field takes whole cells: one of any size, more only within its limit.
    """
    units = [[w] for w in words] if cells is None else cells
    m, tables, made = len(units), [], {}
    for key, _, _, _, least, most, usual, kind in LOCATED:
        known = (listed or {}).get(key, frozenset())
        if (alike := (least, most, usual, kind, known)) in made:  # fields of one kind and size score all runs alike
            tables.append(made[alike])
            continue
        longest = most + 1 if cells is None else m
        t = np.full((min(longest, m) + 1, m + 1), -np.inf)
        for e in range(m + 1):
            run: tuple[str, ...] = ()
            for k in range(min(longest, e) + 1):
                if k:
                    unit = tuple(units[e - k])
                    if cells is not None and run and len(run) + len(unit) > most + 1:
                        break
                    run = unit + run
                t[k, e] = field_score(kind, least, most, usual, run, known)
        tables.append(made.setdefault(alike, t))
    runs = best_chain(tables, skip=False)
    fits = runs[0][0] == 0 and all(a[1] == b[0] for a, b in zip(runs, runs[1:])) and runs[-1][1] == m
    return runs, fits


def segment_forms(forms: DataFrame, text: str, listed: dict[str, set[str]] | None = None, cells: bool = False) -> DataFrame:
    """forms with values map<string,string> (field to words) and overflow (no assignment covers all words).

    listed has known values of some fields (state, card type, agent); at most MOST_LISTED in all, which is checked.
    A text with more words than all fields can take has overflow set and every value empty. With `cells` the column
    has an array of cell texts, of which fields take whole ones; blank cells are left out.
    """
    known = {k: frozenset(x.strip().upper() for x in v if x and x.strip()) for k, v in (listed or {}).items()}
    if sum(map(len, known.values())) > MOST_LISTED:
        raise ValueError(f"more than {MOST_LISTED} known values")
    if cells:
        units = F.transform(F.coalesce(F.col(text), F.array().cast("array<string>")), lambda c: tokens(F.coalesce(c, F.lit(""))))
        rows = forms.withColumn("_words", F.filter(units, lambda c: F.size(c) > 0))
    else:
        rows = forms.withColumn("_words", tokens(F.coalesce(F.col(text), F.lit(""))))
    # A form takes far longer than its bytes tell, so forms are dealt to all tasks, however few files they came from.
    rows = rows.repartition(int(forms.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    most_words, kept = sum(f[5] + 1 for f in LOCATED), forms.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, overflow = [], []
            for words in batch["_words"].to_pylist():
                if len(words) > most_words:
                    runs, fits = [(0, 0)] * len(LOCATED), False
                else:
                    runs, fits = segment([], known, words) if cells else segment(words, known)
                if cells:
                    words = [" ".join(c) for c in words]
                values.append([(f[0], " ".join(words[b:e]) if fits else "") for f, (b, e) in zip(LOCATED, runs)])
                overflow.append(not fits)
            columns = [pa.array(values, pa.map_(pa.string(), pa.string())), pa.array(overflow)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *columns], names=[*kept, "values", "overflow"])

    more = [T.StructField("values", T.MapType(T.StringType(), T.StringType())), T.StructField("overflow", T.BooleanType())]
    return rows.mapInArrow(run, T.StructType([*forms.schema.fields, *more]))
