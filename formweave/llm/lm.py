"""Language-model scores: a causal self-attention model over subword ids, trained in numpy, beside a word unigram base."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, keep, load, mix, pieces, ragged, run_sums, text_bytes
from .langid import in_fold
from .packing import encoder, vocabulary

#: End of a text, and what stands before its first subword.
END_ID = 50256
N_IDS = 50257
#: The head: the most frequent ids, in CLUSTERS times MEMBERS places, the last of which stands for the tail.
CLUSTERS, MEMBERS = 32, 32
HEAD = CLUSTERS * MEMBERS
#: The tail: all other ids, by frequency in so many clusters of so many.
TAIL = 222
WIDTH, HIDDEN = 16, 32
#: Vectors that pairs of successive ids share by hash.
PAIR_BITS = 16
#: Counts of the ids after one id are drawn towards the counts of all ids, as much as by so many more of them.
SMOOTH = 20.0
#: Exponents are cut off here, far beyond what training leads to, so that sums stay finite in single precision.
LARGEST = np.float32(80)
ONES = np.ones(TAIL, np.float32)
#: Inputs in a window, and how far the next window begins after it.
WINDOW, STRIDE = 24, 21
#: Rounds share out all training windows; each trains on all of them up to LEAST_WINDOWS.
ROUNDS, LEAST_WINDOWS = 4, 60_000
#: Windows that one replica is trained on in a round; the replicas' weights are averaged after it.
REPLICA_WINDOWS = 131_072
#: Windows of a step, of a replica with few windows (up to MANY_WINDOWS) and with many.
BATCH, LARGE_BATCH, MANY_WINDOWS = 64, 256, 65_536
#: What each id adds to the hash of a word.
ID_VALUES = mix(np.arange(1, N_IDS + 1, dtype=np.uint64)) | np.uint64(1)
#: A word as frequent as one in HEAVY words is looked up by the tasks; there cannot be more than HEAVY of these.
HEAVY = 1 << 22


def pair_codes(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    return (mix(before.astype(np.uint64) << np.uint64(20) | now.astype(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


class Model:
    """One layer of masked self-attention and a hidden layer, then the subword's cluster and its member in it.

    An input is the sum of vectors for its id, for the pair of it and the id before, and for its place. The outputs
    correct the counted logarithms of which ids follow the last one.
    """

    def __init__(self, counts: np.ndarray, pairs: np.ndarray | None = None, seed: int = 1):
        order = head_order(counts)
        self.slot = np.full(N_IDS, HEAD - 1, np.int64)
        self.slot[order] = np.arange(HEAD - 1)
        rest = np.flatnonzero(self.slot == HEAD - 1)
        rest = rest[np.lexsort((rest, -counts[rest]))]
        self.tail = np.full(N_IDS, -1, np.int64)
        self.tail[rest] = np.arange(len(rest))
        weight = np.zeros(TAIL * TAIL)
        weight[: len(rest)] = counts[rest] + 0.5
        with np.errstate(divide="ignore"):
            weight = np.log(weight).reshape(TAIL, TAIL)
            self.tail_bias = np.log(np.exp(weight).sum(axis=1)).astype(np.float32), np.maximum(weight, -60).astype(np.float32)
        pairs = np.zeros((HEAD, HEAD)) if pairs is None else pairs
        whole = np.bincount(self.slot, counts + 0.5, HEAD)
        after = pairs + SMOOTH * whole / whole.sum()
        after = (after / after.sum(axis=1, keepdims=True)).reshape(HEAD, CLUSTERS, MEMBERS)
        cluster = after.sum(axis=2)
        self.bias = np.log(cluster).astype(np.float32), np.log(after / cluster[:, :, None]).astype(np.float32).reshape(HEAD * CLUSTERS, MEMBERS)
        rng = np.random.Generator(np.random.PCG64(seed))
        shapes = {"P": (WINDOW, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH), "h": (WIDTH, HIDDEN), "hb": (HIDDEN,), "u": (HIDDEN, WIDTH), "c": (WIDTH, CLUSTERS), "m": (CLUSTERS, WIDTH, MEMBERS), "t": (WIDTH, TAIL)}
        size = {"P": 0.1, "hb": 0.0, "c": 0.05, "m": 0.05, "t": 0.05}
        self.p = {n: (rng.standard_normal(s) * size.get(n, WIDTH**-0.5)).astype(np.float32) for n, s in shapes.items()}
        #: Tables of which a batch touches few rows: vectors of ids and of pairs, and the tail's members by cluster.
        self.rows = {"E": (rng.standard_normal((N_IDS, WIDTH)) * 0.5).astype(np.float32), "G": np.zeros((1 << PAIR_BITS, WIDTH), np.float32), "T": np.zeros((TAIL, WIDTH * TAIL), np.float32)}
        self.seen = {n: np.full(len(v), 1e-8, np.float32) for n, v in self.rows.items()}  # sums of squared gradients

    def forward(self, x: np.ndarray, g: np.ndarray) -> dict[str, np.ndarray]:
        """All layers over windows of ids and of pair codes (n, length), as the gradients need them."""
        p, (n, w) = self.p, x.shape
        t = {"x": self.rows["E"][x] + self.rows["G"][g] + p["P"][:w]}
        flat = t["x"].reshape(-1, WIDTH)
        t["q"], t["k"], t["v"] = np.split((flat @ np.concatenate((p["q"] * np.float32(WIDTH**-0.5), p["k"], p["v"]), axis=1)).reshape(n, w, -1), 3, axis=2)
        s = t["q"] @ t["k"].transpose(0, 2, 1)
        np.clip(s, -LARGEST, LARGEST, out=s)
        np.exp(s, out=s)
        s *= np.tri(w, dtype=np.float32)
        s *= 1 / (s @ ONES[:w, None])
        t["a"], t["z"] = s, s @ t["v"]
        t["y"] = t["x"] + t["z"] @ p["o"]
        t["r"] = np.maximum(t["y"] @ p["h"] + p["hb"], 0)
        t["out"] = (t["y"] + t["r"] @ p["u"]).reshape(-1, WIDTH)
        return t

    def outputs(self, x: np.ndarray, g: np.ndarray, begin: int) -> np.ndarray:
        """The same outputs as forward() from place `begin` on, for scoring alone."""
        p, (n, w) = self.p, x.shape
        e = self.rows["E"][x]
        e += self.rows["G"][g]
        e += p["P"][:w]
        kv = (e.reshape(-1, WIDTH) @ np.concatenate((p["k"], p["v"], np.zeros((WIDTH, 1), np.float32)), axis=1)).reshape(n, w, -1)
        kv[:, :, -1] = 1  # sums the weights beside the values
        late = np.ascontiguousarray(e[:, begin:]).reshape(-1, WIDTH)
        s = (late @ (p["q"] * np.float32(WIDTH**-0.5))).reshape(n, w - begin, WIDTH) @ kv[:, :, :WIDTH].transpose(0, 2, 1)
        np.minimum(s, LARGEST, out=s)
        np.exp(s, out=s)
        s *= np.tri(w, dtype=np.float32)[begin:]
        z = (s @ kv[:, :, WIDTH:]).reshape(-1, WIDTH + 1)
        y = late + (z[:, :WIDTH] / z[:, WIDTH:]) @ p["o"]
        r = y @ p["h"]
        r += p["hb"]
        np.maximum(r, 0, out=r)
        y += r @ p["u"]
        return y

    def log_probability(self, out: np.ndarray, last: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each target id after each of outputs(), whose last ids are given."""
        p, last, place = self.p, self.slot[last], self.slot[target]
        cluster, member = (place // MEMBERS).astype(np.int16), place % MEMBERS
        order = np.argsort(cluster, kind="stable")
        sorted_, last, cluster, member = out[order], last[order], cluster[order], member[order]
        edges = np.searchsorted(cluster, np.arange(CLUSTERS + 1))
        c, m, rows = sorted_ @ p["c"], np.empty((len(out), MEMBERS), np.float32), np.arange(len(out))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            np.matmul(sorted_[edges[k] : edges[k + 1]], p["m"][k], out=m[edges[k] : edges[k + 1]])
        c += self.bias[0][last]
        m += self.bias[1][last * CLUSTERS + cluster]
        result = np.empty(len(out))
        result[order] = chance(c, cluster, rows) + chance(m, member, rows)
        rare = np.flatnonzero(place == HEAD - 1)
        if len(rare):
            group, member = np.divmod(self.tail[target[rare]], TAIL)
            result[rare] += chance(out[rare] @ p["t"] + self.tail_bias[0], group, np.arange(len(rare)))
            for at in range(0, len(rare), 256):
                i, g = rare[at : at + 256], group[at : at + 256]
                logits = (out[i][:, None] @ self.rows["T"][g].reshape(-1, WIDTH, TAIL))[:, 0] + self.tail_bias[1][g]
                result[i] += chance(logits, member[at : at + 256], np.arange(len(i)))
        return result

    def gradients(self, x: np.ndarray, g: np.ndarray, y: np.ndarray, wanted: np.ndarray) -> tuple[float, dict, dict]:
        """Mean loss over the wanted places, gradients of p, and of rows as (row numbers, gradients)."""
        p, (n, w) = self.p, x.shape
        t, some = self.forward(x, g), np.flatnonzero(wanted.ravel())
        grad = {name: np.zeros_like(v) for name, v in p.items()}
        last, target = self.slot[x.ravel()[some]], y.ravel()[some]
        order = np.argsort((self.slot[target] // MEMBERS).astype(np.int16), kind="stable")  # by cluster
        some, last, target = some[order], last[order], target[order]
        place = self.slot[target]
        out, count = t["out"][some], np.float32(max(1, len(some)))
        cluster, member = np.divmod(place, MEMBERS)
        edges = np.searchsorted(cluster, np.arange(CLUSTERS + 1)).tolist()

        def step(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
            """Gradient of the logits; adds to the loss."""
            nonlocal loss
            np.clip(logits, -LARGEST, LARGEST, out=logits)
            np.exp(logits, out=logits)
            here, whole = np.arange(len(at)), logits @ ONES[: logits.shape[1]]
            own = logits[here, at]
            loss -= float(np.log(own / whole + 1e-30).sum())
            whole *= count
            logits *= (1 / whole)[:, None]
            logits[here, at] -= 1 / count
            return logits

        loss = 0.0
        c = step(out @ p["c"] + self.bias[0][last], cluster)
        grad["c"], d = out.T @ c, c @ p["c"].T
        bias, m = self.bias[1][last * CLUSTERS + cluster], np.empty((len(some), MEMBERS), out.dtype)
        parts = [(k, slice(*edges[k : k + 2])) for k in range(CLUSTERS) if edges[k] < edges[k + 1]]
        for k, i in parts:
            np.matmul(out[i], p["m"][k], out=m[i])
        m += bias
        m = step(m, member)
        for k, i in parts:
            grad["m"][k] = out[i].T @ m[i]
            d[i] += m[i] @ p["m"][k].T
        rare = np.flatnonzero(place == HEAD - 1)
        groups, tails = np.zeros(0, np.int64), []
        if len(rare):
            group, member = np.divmod(self.tail[target[rare]], TAIL)
            c = step(out[rare] @ p["t"] + self.tail_bias[0], group)
            grad["t"] = out[rare].T @ c
            d[rare] += c @ p["t"].T
            groups = np.unique(group)
            for k in groups.tolist():
                i = rare[group == k]
                m = step(out[i] @ self.rows["T"][k].reshape(WIDTH, TAIL) + self.tail_bias[1][k], member[group == k])
                tails.append((out[i].T @ m).ravel())
                d[i] += m @ self.rows["T"][k].reshape(WIDTH, TAIL).T
        flat = lambda v: v.reshape(-1, v.shape[-1])
        every = np.zeros((n * w, WIDTH), np.float32)
        every[some] = d
        r = flat(t["r"])
        grad["u"] = r.T @ every
        dr = (every @ p["u"].T) * (r > 0)
        grad["h"], grad["hb"] = flat(t["y"]).T @ dr, dr.sum(axis=0)
        dy = every + dr @ p["h"].T
        grad["o"] = flat(t["z"]).T @ dy
        dz = (dy @ p["o"].T).reshape(n, w, WIDTH)
        da = dz @ t["v"].transpose(0, 2, 1)
        dv = t["a"].transpose(0, 2, 1) @ dz
        ds = t["a"] * (da - (da * t["a"]).sum(axis=2, keepdims=True))
        dq, dk = ds @ t["k"] * np.float32(WIDTH**-0.5), ds.transpose(0, 2, 1) @ t["q"]
        xs = flat(t["x"])
        every = np.concatenate((flat(dq), flat(dk), flat(dv)), axis=1)
        grad["q"], grad["k"], grad["v"] = np.split(xs.T @ every, 3, axis=1)
        dx = dy + every @ np.concatenate((p["q"], p["k"], p["v"]), axis=1).T
        grad["P"][:w] = dx.reshape(n, w, WIDTH).sum(axis=0)
        return loss / float(count), grad, {"E": summed(x.ravel(), dx), "G": summed(g.ravel(), dx), "T": (groups, np.array(tails, np.float32).reshape(len(groups), WIDTH * TAIL))}

    def train(self, windows: np.ndarray, part: float = 0.0, share: float = 1.0, batch: int = BATCH, rate: float = 4e-3, row_rate: float = 0.2) -> float:
        """One pass over windows (two ids before the first target, then targets; -1: nothing): Adam for p, Adagrad by
        rows for the tables. The rates fall over all rounds, of which this pass is the share that begins at part."""
        first, second = ({n: np.zeros_like(v) for n, v in self.p.items()} for _ in range(2))
        steps, total = -(-len(windows) // batch), 0.0
        for i in range(steps):
            w = windows[i * batch : (i + 1) * batch].astype(np.int64)
            given, y = np.where(w < 0, END_ID, w)[:, :-1], w[:, 2:]
            loss, grad, rows = self.gradients(given[:, 1:], pair_codes(given[:, :-1], given[:, 1:]), np.maximum(y, 0), y >= 0)
            total += loss * len(w)
            fall = 1 - 0.9 * (part + share * i / steps)
            for n, v in self.p.items():
                first[n] += 0.1 * (grad[n] - first[n])
                second[n] += 0.01 * (grad[n] * grad[n] - second[n])
                v -= (rate * fall * min(1.0, (i + 1) / 30) * (first[n] / (1 - 0.9 ** (i + 1))) / (np.sqrt(second[n] / (1 - 0.99 ** (i + 1))) + 1e-8)).astype(np.float32)
            for n, (at, d) in rows.items():
                self.seen[n][at] += (d * d).mean(axis=1)
                self.rows[n][at] -= np.float32(row_rate * fall * (0.1 if n == "T" else 1)) * d / np.sqrt(self.seen[n][at])[:, None]
        return total / max(1, len(windows))

    def score(self, texts: list[np.ndarray], batch: int = 400) -> np.ndarray:
        """log10 probability of each text (subword ids without the end): each id and the end are scored once.

        Windows of WINDOW inputs begin every STRIDE inputs; all but a text's first score only what lies beyond the
        window before, after WINDOW - STRIDE inputs of context.
        """
        size = np.array([len(t) + 1 for t in texts], np.int64)
        more = np.maximum(-(-(size - WINDOW) // STRIDE), 0)
        base = np.cumsum(size) - size
        ids = np.full(int(size.sum()) + WINDOW, END_ID, np.int64)
        for t, b in zip(texts, base.tolist()):
            ids[b : b + len(t)] = t
        given = np.concatenate(([END_ID], ids[:-1]))  # the end of the text before stands before a text's first id
        codes = pair_codes(np.concatenate(([END_ID], given[:-1])), given)
        codes[base] = pair_codes(np.array([END_ID]), np.array([END_ID]))[0]
        logs = np.zeros(len(ids))
        context = WINDOW - STRIDE
        # first windows, whole; then the others, which score STRIDE places each
        later = np.concatenate([b + STRIDE * np.arange(1, m + 1) for b, m in zip(base, more)] or [base[:0]])
        end = np.repeat(base + size, more)
        for starts, limit, begin in ((base, base + size, 0), (later, end, context)):
            for at in range(0, len(starts), batch):
                s, e = starts[at : at + batch], limit[at : at + batch]
                where = s[:, None] + np.arange(WINDOW)
                out = self.outputs(given[where], codes[where], begin)
                where = where[:, begin:]
                true = (where < e[:, None]).ravel()  # what lies beyond the text comes after all of it
                where = where.ravel()[true]
                logs[where] = self.log_probability(out[true], given[where], ids[where])
        return np.add.reduceat(logs[: int(size.sum())], base) / np.log(10) if len(texts) else np.zeros(0)


def head_order(counts: np.ndarray) -> np.ndarray:
    """The ids of the head: the end, then the most frequent ones."""
    order = np.lexsort((np.arange(N_IDS), -counts))
    return np.concatenate(([END_ID], order[order != END_ID]))[: HEAD - 1]


def chance(logits: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax at one place of each row."""
    np.minimum(logits, LARGEST, out=logits)
    own = logits[rows, at]
    np.exp(logits, out=logits)
    return own.astype(np.float64) - np.log(logits @ ONES[: logits.shape[1]])


def summed(rows: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct row numbers (below 2^16), and the sum of d for each."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # by radix
    rows = rows[order]
    at = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    return rows[at], np.add.reduceat(d[order], at, axis=0)


def id_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All subword ids of a column of tokens(), and the offsets of each row."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint16) if body else np.zeros(0, np.uint16)
    return data[offsets[0] // 2 : offsets[-1] // 2], (offsets - offsets[0]) // 2


def spelled(ids: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes of the ids one after the other, and the offsets of each row in them."""
    letters, starts = vocabulary()
    size = np.diff(starts)[ids]
    before = np.concatenate(([0], np.cumsum(size)))
    return letters[ragged(starts[ids], size)].tobytes(), before[offsets]


def tokens(docs: DataFrame, held_out) -> DataFrame:
    """row (a number for each row), doc_id, held_out and ids (subwords of the tidy lower-cased text, two bytes each).

    Every word is preceded by one space, so that the ids spell the words that the base counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in pieces(batches, limit=1 << 20):
            data, offsets = text_bytes(batch)
            # words by the white space of ASCII, A-Z in lower case, one space before each
            texts = [b" ".join([b"", *data[s:e].lower().split()]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            ids = [encode(t.decode(), True).astype(np.uint16).tobytes() if t else b"" for t in texts]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], batch["held_out"], pa.array(ids, pa.binary())], names=["row", "doc_id", "held_out", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, held_out boolean, ids binary")


def id_words(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last id (exclusive) of each word, for each row the number of words before it, and the words' hashes."""
    letters, at = vocabulary()
    first = np.zeros(N_IDS, np.uint8)
    first[:-1] = letters[at[:-2]]
    starts = np.flatnonzero(first[ids] == 32)
    ends = np.append(starts[1:], len(ids))[: len(starts)]
    return starts, ends, np.searchsorted(starts, offsets), run_sums(ID_VALUES[ids], starts, ends)


def named(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The words without the space before them."""
    size = ends - starts
    data, at = spelled(ids[ragged(starts, size)], np.concatenate(([0], np.cumsum(size))))
    return [data[s + 1 : e] for s, e in zip(at[:-1].tolist(), at[1:].tolist())]


def count_words(rows: DataFrame) -> DataFrame:
    """word, h (its hash), c: how often each word stands in all rows of tokens(). Tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "ids"):
            ids, offsets = id_rows(batch["ids"])
            starts, ends, _, h = id_words(ids, offsets)
            of, h = pd.factorize(h)
            at = np.empty(len(h), np.int64)
            at[of[::-1]] = np.arange(len(of) - 1, -1, -1)  # the first place of each
            n = np.bincount(of, minlength=len(h))
            yield pa.RecordBatch.from_arrays([pa.array(named(ids, starts[at], ends[at]), pa.binary()), pa.array(h.view(np.int64)), pa.array(n)], names=["word", "h", "c"])

    return rows.select("ids").mapInArrow(run, "word binary, h long, c long").groupBy("word").agg(F.first("h").alias("h"), F.sum("c").alias("c"))


def counted(rows: DataFrame, codes, n: int) -> np.ndarray:
    """How often each of n codes comes from codes(ids, offsets) over all rows; tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in pieces(batches, "ids", 1 << 20):
            total += np.bincount(codes(*id_rows(batch["ids"])), minlength=n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["code", "n"])

    found = rows.select("ids").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n, np.int64)
    out[np.asarray(found["code"])] = np.asarray(found["n"])
    return out


def following(slot: np.ndarray):
    """Codes of successive places of the head in each row, from and to the end."""

    def codes(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        place = slot[ids]
        own = np.zeros(len(ids) + len(offsets), np.int64)  # slot 0 is the end
        own[np.arange(len(ids)) + np.repeat(np.arange(1, len(offsets)), np.diff(offsets))] = place
        return own[:-1] * HEAD + own[1:]

    return codes


def windows_of(rows: DataFrame, end: float, seed: int, begin: float = 0.0) -> DataFrame:
    """place, w: all training windows whose hashes are from the share `begin` of all hashes up to the share `end` (beyond
    1: from the first on again). Each id and end of a text is a target of one window."""
    every_one, origin = end - begin >= 1, int(begin * (1 << 64))
    size = np.uint64(0 if every_one else int(end * (1 << 64)) - origin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "ids", 1 << 20):
            ids, offsets = id_rows(batch["ids"])
            count = np.diff(offsets) // WINDOW + 1
            text = np.repeat(np.arange(len(count)), count)
            at = ragged(np.zeros(len(count), np.int64), count)
            name = mix(mix(np.asarray(batch["row"]).astype(np.uint64))[text] + (at.astype(np.uint64) << np.uint64(8)) + np.uint64(seed))
            chosen = np.arange(len(name)) if every_one else np.flatnonzero(name - np.uint64(origin) < size)
            # each text with two ends before it and one after, nothing beyond
            base = offsets[:-1] + 3 * np.arange(len(count))
            every = np.full(len(ids) + 3 * len(count) + WINDOW + 2, END_ID, "<i4")
            every[np.arange(len(ids)) + np.repeat(3 * np.arange(len(count)) + 2, np.diff(offsets))] = ids
            place = (base[text[chosen]] + at[chosen] * WINDOW)[:, None] + np.arange(WINDOW + 2)
            out = every[place]
            out[place >= (base + np.diff(offsets) + 3)[text[chosen]][:, None]] = -1
            ends = np.arange(len(out) + 1, dtype=np.int32) * (4 * (WINDOW + 2))
            raw = pa.BinaryArray.from_buffers(pa.binary(), len(out), [None, pa.py_buffer(ends), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([pa.array(name[chosen].view(np.int64)), raw], names=["place", "w"])

    return rows.select("row", "ids").mapInArrow(run, "place long, w binary")


def fit(rows: DataFrame, rounds: int = ROUNDS, least: int = LEAST_WINDOWS) -> Model:
    """The model for the training rows of tokens(), which learns from all of them.

    Counts of ids and of successive ids cover all of them. The weights are fitted in rounds, which share out all windows,
    so that each is trained on once, and oftener where there are few. Replicas that start from the same weights are
    trained on REPLICA_WINDOWS each, and their weights are averaged, tables by how much a replica moved each row.
    """
    size = F.length("ids") / 2
    n, windows = rows.agg(F.count("*"), F.coalesce(F.sum(F.floor(size / WINDOW) + 1), F.lit(0))).first()
    counts = counted(rows, lambda ids, offsets: ids, N_IDS)
    counts[END_ID] += n
    slot = np.full(N_IDS, HEAD - 1, np.int64)
    slot[head_order(counts)] = np.arange(HEAD - 1)
    model = Model(counts, counted(rows, following(slot), HEAD * HEAD).reshape(HEAD, HEAD) if n else None)
    share = least / max(1, windows)
    replicas = max(1, round(min(1.0, max(1 / rounds, share)) * windows / REPLICA_WINDOWS))
    for r in range(rounds if windows else 0):
        drawn = windows_of(rows, max((r + 1) / rounds, r / rounds + share), 0, r / rounds)
        improve(model, drawn.repartition(replicas), replicas, r / rounds, 1 / rounds)
    return model


def improve(model: Model, drawn: DataFrame, replicas: int, part: float, share: float, group: int = 16) -> None:
    """One round: a replica for each partition of the windows, and their average, made in tasks of `group` replicas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, raw = [np.zeros(0, np.int64)], []
        for batch in batches:
            place.append(np.asarray(batch["place"]))
            raw.append(text_bytes(batch, "w")[0])
        order = np.argsort(np.concatenate(place), kind="stable")
        if n := len(order):
            windows = np.frombuffer(b"".join(raw), "<i4").reshape(n, WINDOW + 2)[order]
            before = {k: v.copy() for k, v in model.seen.items()}
            model.train(windows, part, share, LARGE_BATCH if n > MANY_WINDOWS else BATCH)
            out = [np.float32([n]), *(v.ravel() * np.float32(n) for v in model.p.values())]
            for k, v in model.rows.items():
                moved = model.seen[k] - before[k]
                out += [moved, (v * moved[:, None]).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(out).astype("<f4").tobytes()], pa.binary())], names=["x"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch["x"]:
                x = np.frombuffer(x.as_buffer(), "<f4").astype(np.float64)
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f4").tobytes()], pa.binary())], names=["x"])

    found = drawn.mapInArrow(run, "x binary")
    while replicas > 1:
        replicas = -(-replicas // group)
        found = found.repartition(replicas).mapInArrow(add, "x binary")
    found = keep(found, "model")
    got = found.collect()  # one row at most
    discard(found)
    if not got:
        return
    x, at = np.frombuffer(got[0].x, "<f4"), 1
    for k, v in model.p.items():
        model.p[k] = (x[at : at + v.size] / x[0]).reshape(v.shape)
        at += v.size
    for k, v in model.rows.items():
        moved, at = x[at : at + len(v)], at + len(v)
        mean, at = x[at : at + v.size].reshape(v.shape), at + v.size
        some = moved > 0
        v[some] = mean[some] / moved[some, None]
        model.seen[k] += moved


def scored(rows: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of tokens().

    Words that are frequent enough to be few (at most HEAVY) are looked up in the tasks; occurrences of the others
    are counted by text, and joined with the counts of all words.
    """
    n_words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_train = rows.where("not held_out").count()
    total = n_words + n_train
    kinds = distinct + (1 if n_train else 0)
    limit = max(2, -(-n_words // HEAVY))

    frequent = counts.where(F.col("c") >= limit).select("h", "c").toArrow()
    keys, values = np.asarray(frequent["h"]).view(np.uint64), np.asarray(frequent["c"])
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    end_log = float(np.log10(n_train + 1))
    known_end = int(n_train > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "ids", 1 << 20):
            ids, at = id_rows(batch["ids"])
            score = model.score([ids[s:e] for s, e in zip(at[:-1].tolist(), at[1:].tolist())])
            starts, ends, first, h = id_words(ids, at)
            of, different = pd.factorize(h)
            at = np.searchsorted(keys, different)
            at[at == len(keys)] = 0
            c = (np.where(keys[at] == different, values[at], 0) if len(keys) else np.zeros(len(different), np.int64))[of]
            sums = np.concatenate(([0], np.cumsum(np.log10(c + 1.0))))
            known = np.concatenate(([0], np.cumsum(c > 0)))
            text = np.repeat(np.arange(batch.num_rows), np.diff(first))
            rare = np.flatnonzero(c == 0)
            rare = rare[np.lexsort((of[rare], text[rare]))]
            new = np.concatenate(([True], (of[rare][1:] != of[rare][:-1]) | (text[rare][1:] != text[rare][:-1]))) if len(rare) else np.zeros(0, bool)
            one = np.flatnonzero(new)
            times = np.diff(np.append(one, len(rare)))
            rare = rare[one]
            entries = pa.StructArray.from_arrays([pa.array(named(ids, starts[rare], ends[rare]), pa.binary()), pa.array(times)], names=["word", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text[rare], np.arange(batch.num_rows + 1)).astype(np.int32)), entries)
            columns = [pa.array(np.diff(first) + 1), pa.array(known[first[1:]] - known[first[:-1]] + known_end), pa.array(sums[first[1:]] - sums[first[:-1]] + end_log), pa.array(score), lists]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], batch["held_out"], *columns], names=["row", "doc_id", "held_out", "n_tokens", "known", "logs", "score", "rare"])

    done = keep(rows.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, score double, rare array<struct<word:binary,n:bigint>>"), "scores")
    rest = done.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.n").join(counts.where(F.col("c") < limit).select("word", "c"), "word")
    rest = rest.groupBy("row").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("logs_"))
    out = done.drop("rare").join(rest, "row", "left")
    base = F.col("logs") + F.coalesce("logs_", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(total + kinds + 1)))
    known = (F.col("known") + F.coalesce("n", F.lit(0))).cast("long")
    return out.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def lm_scores(docs: DataFrame, folds: int = 7, fold: int = 2, rounds: int = ROUNDS, least: int = LEAST_WINDOWS) -> DataFrame:
    """Scores of all rows of docs, by what the rows outside one fold (crc32 of the id as text) teach.

    The base and its counts cover every word of every training text; the model's vocabulary, the counts that its outputs
    correct and its weights cover every id of these: `rounds` rounds share out all their windows (and are over about
    `least` windows each at least). A null or empty text is the end alone; a null id counts as an empty text in the fold.
    Repeated rows are rows like others. Texts of any length are scored whole.
    """
    rows = keep(tokens(docs, in_fold(F.col("doc_id"), folds, fold)), "tokens")
    training = rows.where("not held_out")
    counts = keep(count_words(training), "words")
    out = scored(rows, counts, fit(training, rounds, least))
    discard(rows)
    return out


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(load(spark, sf_dir, "documents").select("doc_id", "text"))
