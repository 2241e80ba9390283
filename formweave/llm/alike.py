"""Near-duplicates by similarity of word shingles: wide SimHash fingerprints, pigeonhole blocks, then exact sets.

Two texts whose sets of shingles have the Jaccard similarity s differ, on average, in the share acos(2s / (1 + s)) / pi
of the bits of a fingerprint over these sets. For s = 0.8 that is 15 %, too many for all choices of blocks. So several
permutations of the fingerprint are each split into blocks, and there are as many blocks as a pair of that similarity
needs to share one with the wanted recall. Pairs that share a block, and few differing bits, are verified on the sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep, mix, pieces, ragged, text_bytes
from .components import connected_components, in_groups, in_parts
from .simhash import majority_bits, shingle_hashes

#: Similarity from which texts are near-duplicates: UP / DOWN.
UP, DOWN = 4, 5
#: 64-bit words of a fingerprint.
WORDS = 3
#: Columns of these.
PRINT = [f"f{i}" for i in range(WORDS)]
#: Columns of a member of a group, in the part of it where in_groups() compares it.
DEALT = ["key", "a", "component", *PRINT, "_i", "_j", "_left"]
#: Groups of up to so many texts with a block in common are compared whole at once, and each text is paired with the
#: nearest before it; in larger ones each is compared with the first and with the next NEXT at first. What those links
#: have not joined is paired afterwards.
SMALL, NEXT = 64, 2
#: Texts that share a block with a text by chance.
CHANCE = 8
#: Bits of the filter that holds which texts are wanted.
FILTER_BITS = 1 << 24


class Blocks:
    """Which bits of a fingerprint each block has: enough blocks for `recall` at the least similarity, each of so many
    bits that a text meets few others by chance."""

    def __init__(self, count: int, recall: float = 0.95, seed: int = 11):
        self.share = acos(2 * UP / (UP + DOWN)) / pi
        self.bits = min(40, max(8, ceil(log2(max(2, count / CHANCE)))))
        every, rng = 64 * WORDS, np.random.Generator(np.random.PCG64(seed))
        # pairs differ in d bits by the binomial law; of these, a block of other bits is free with the chance `free`
        chance = np.array([comb(every, d) * self.share**d * (1 - self.share) ** (every - d) for d in range(every + 1)])
        free = np.array([comb(every - d, self.bits) / comb(every, self.bits) for d in range(every + 1)])
        need = next(k for k in range(1, 1 << 16) if chance @ (1 - free) ** k <= 1 - recall)
        each = every // self.bits
        order = np.concatenate([rng.permutation(every)[: each * self.bits].reshape(each, self.bits) for _ in range(-(-need // each))])
        self.places = order[:need]
        #: Beyond the mean by four standard deviations: one pair in 30,000 at the least similarity differs in more bits.
        self.distance = int(every * self.share + 4 * (every * self.share * (1 - self.share)) ** 0.5)
        self.masks = np.zeros((WORDS, need), np.uint64)
        for t, p in enumerate(self.places):
            for x in p.tolist():
                self.masks[x // 64, t] |= np.uint64(1 << x % 64)

    def keys(self, prints: np.ndarray) -> np.ndarray:
        """(n, blocks) keys of fingerprints (n, WORDS): the block's number and its bits."""
        bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little").astype(np.float64)
        weight = np.zeros((64 * WORDS, len(self.places)))
        for t, p in enumerate(self.places):
            weight[p, t] = 2.0 ** np.arange(self.bits)
        return (bits @ weight).astype(np.int64) + (np.arange(len(self.places)) << 44)

    def first_shared(self, differ: np.ndarray) -> np.ndarray:
        """The first block in which two fingerprints agree, given their differing bits (n, WORDS)."""
        out = np.full(len(differ), len(self.places))
        open_ = np.arange(len(differ))
        for t in range(len(self.places)):
            same = np.zeros(len(open_), np.uint64)
            for w in range(WORDS):
                same |= differ[open_, w] & self.masks[w, t]
            out[open_[same == 0]] = t
            open_ = open_[same != 0]
        return out


def shingle_sets(batch: pa.RecordBatch, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in ascending order, text by text, and how many each text has."""
    hashes, count = shingle_hashes(*text_bytes(batch), size, seed)
    row = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.bincount(row[new], minlength=len(count))


def node_of(prints: np.ndarray) -> np.ndarray:
    """The number of a node: a hash of all bits of its fingerprint."""
    out = np.zeros(len(prints), np.uint64)
    for w in range(WORDS):
        out = mix(out + prints[:, w] + np.uint64(w + 1))
    return out.view(np.int64)


def wide_fingerprints(texts: DataFrame, size: int, seed: int) -> DataFrame:
    """doc_id, _digest, node and f0, f1, ...: the fingerprint over distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=1 << 20):
            h, n = shingle_sets(batch, size, seed)
            prints = []
            for _ in range(WORDS):
                prints.append(majority_bits(h, n))
                h = mix(h + np.uint64(1))
            node = node_of(np.stack(prints, axis=1))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["_digest"], pa.array(node), *(pa.array(p.view(np.int64)) for p in prints)], names=["doc_id", "_digest", "node", *PRINT])

    return texts.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "_digest", "node", *PRINT)))


def keyed(nodes: DataFrame, blocks: Blocks) -> DataFrame:
    """key, f0, f1, ... for each block of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                keys = blocks.keys(prints_of(part))
                of = pa.array(np.repeat(np.arange(part.num_rows), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(part[c].take(of) for c in PRINT)], names=["key", *PRINT])

    return nodes.select(*PRINT).mapInArrow(run, ", ".join(f"{c} long" for c in ("key", *PRINT)))


def prints_of(table) -> np.ndarray:
    return np.stack([np.asarray(table[f"f{i}"]).view(np.uint64) for i in range(WORDS)], axis=1) if table.num_rows else np.zeros((0, WORDS), np.uint64)


def meetings(rows: DataFrame, blocks: Blocks, small: int = SMALL) -> DataFrame:
    """a, b, differ: pairs of nodes that share a block and differ in few bits, each for its first block alone and at most
    two for each row: with the nearest before it and with the group's first. And rows (key, a, f0, f1, ...; b null) of
    the nodes that may have more such partners in their group: both ends of pairs left out, and all members of groups too
    large to be compared whole.

    So there are no more rows than members of groups, however many pairs these make. Rows come sorted by block. A task holds the first row of the present group and its last `small` rows, however
    large the group is.
    """
    fields = ["key", "a", "b", "differ", *PRINT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, prints, place = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, WORDS), np.uint64), np.zeros(0, np.int64)
        head = None  # node and fingerprint of the first row of the present group
        for batch in batches:
            old = len(key)
            k = np.asarray(batch["key"])
            key, node, prints = np.concatenate((key, k)), np.concatenate((node, node_of(prints_of(batch)))), np.concatenate((prints, prints_of(batch)))
            # place of each row in its group: groups that begin in an earlier batch count on
            start = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
            number = np.arange(len(key))
            begin = np.maximum.accumulate(np.where(start, number, 0))
            base = np.zeros(len(key), np.int64)
            if old:
                first = np.flatnonzero(start)
                upto = first[1] if len(first) > 1 else len(key)
                base[:upto] = place[0]
            place = number - begin + base
            fresh = np.arange(old, len(key))
            pairs = []
            for d in range(1, small):
                i = fresh[(place[fresh] >= d) & (fresh >= d)]
                i = i[(place[i] < small) | (d <= NEXT)]
                if not len(i):
                    break
                pairs.append((i - d, i))
            left = np.concatenate([p for p, _ in pairs] or [fresh[:0]])
            right = np.concatenate([q for _, q in pairs] or [fresh[:0]])
            one, two, at = prints[left], prints[right], right
            a, b = node[left], node[right]
            far = fresh[place[fresh] >= small]
            if len(far):
                here = base[far] == 0  # the group's first row is still held
                f = np.where(here[:, None], prints[begin[far]], head[1] if head else np.uint64(0))
                n = np.where(here, node[begin[far]], head[0] if head else 0)
                one, two, at = np.concatenate((one, f)), np.concatenate((two, prints[far])), np.concatenate((at, far))
                a, b = np.concatenate((a, n)), np.concatenate((b, node[far]))
            differ = one ^ two
            bits = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
            near = np.flatnonzero((bits <= blocks.distance) & (a != b))
            near = near[blocks.first_shared(differ[near]) == key[at[near]] >> 44]
            # of the partners before it each row keeps the nearest: one pair for a row, not all pairs of its group
            own = near[near < len(left)]
            own = own[np.lexsort((own, bits[own], right[own]))]
            later = np.concatenate(([False], right[own][1:] == right[own][:-1])) if len(own) else np.zeros(0, bool)
            near = np.concatenate((own[~later], near[near >= len(left)]))
            unsaid = np.unique(np.concatenate((left[own[later]], right[own[later]])))
            none = pa.nulls(len(near), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(np.minimum(a[near], b[near])), pa.array(np.maximum(a[near], b[near])), pa.array(bits[near])] + [none] * WORDS, names=fields)
            # members of large groups: once a group proves large, also those already seen
            large = fresh[place[fresh] >= small]
            turn = large[place[large] == small]
            back = np.concatenate([np.arange(t - small, t) for t in turn] or [large[:0]])
            out = np.concatenate((back[back >= 0], large, unsaid[place[unsaid] < small]))
            none = pa.nulls(len(out), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(node[out]), none, none, *(pa.array(prints[out, w].view(np.int64)) for w in range(WORDS))], names=fields)
            if len(key):
                last = len(key) - 1
                if base[last] == 0:
                    head = node[begin[last]], prints[begin[last]]
                s = max(int(begin[last]), len(key) - small)
                key, node, prints, place = key[s:], node[s:], prints[s:], place[s:]

    return rows.repartition("key").sortWithinPartitions("key", *PRINT).mapInArrow(run, ", ".join(f"{c} long" for c in fields))


def unjoined(blocks: Blocks, table: pa.Table, bounds: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each group its first row, its end, and from the first on the places of all pairs in different components that
    differ in few bits, each for its first block alone."""
    key, node, part, prints = np.asarray(table["key"]), np.asarray(table["a"]), np.asarray(table["component"]), prints_of(table)
    cross, left = np.asarray(table["_i"]) != np.asarray(table["_j"]), np.asarray(table["_left"])
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        bits = sum(np.bitwise_count(prints[s:e, None, w] ^ prints[None, s:e, w]).astype(np.int16) for w in range(WORDS))
        near = (bits <= blocks.distance) & (node[s:e, None] < node[None, s:e]) & (part[s:e, None] != part[None, s:e])
        if cross[s]:
            near &= left[s:e, None] != left[None, s:e]
        i, j = np.nonzero(near)
        first = blocks.first_shared(prints[s:e][i] ^ prints[s:e][j]) == key[s] >> 44
        yield s, e, i[first], j[first]


def apart(blocks: Blocks):
    """The members of each group that are in a pair of unjoined(), as they were dealt: no more rows than members, however
    many the pairs."""

    def compare(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s, _, i, j in unjoined(blocks, table, bounds):
            some = pa.array(s + np.unique(np.concatenate((i, j))))
            yield from table.select(DEALT).take(some).combine_chunks().to_batches()

    return compare


def joined(blocks: Blocks):
    """Links (a, b) between members of each group in different components, from their sets: all pairs of unjoined() that
    earlier ones of the group have not joined are compared, and only what joins two components is a row."""

    def compare(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        node, part, sets = np.asarray(table["a"]), np.asarray(table["component"]), table["set"].chunk(0)
        at, values = np.asarray(sets.offsets).astype(np.int64), np.asarray(sets.values)
        for s, e, i, j in unjoined(blocks, table, bounds):
            found = joining(part[s:e], values[at[s] : at[e]], at[s : e + 1] - at[s], i, j)
            yield pa.RecordBatch.from_arrays([pa.array(node[s + found[:, 0]]), pa.array(node[s + found[:, 1]])], names=["a", "b"])

    return compare


def joining(part: np.ndarray, values: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, limit: int = 1 << 20) -> np.ndarray:
    """Rows (i, j) of the pairs of sets at least so similar that join components not yet joined by rows before.
    i: ascending; at: where each set begins in values."""
    label, ids = np.unique(part, return_inverse=True)[1], np.unique(values, return_inverse=True)[1]
    size, inside = np.diff(at), np.zeros(len(ids) + 1, np.int64)
    alone, begin = np.unique(i, return_index=True)
    out = [np.zeros((0, 2), np.int64)]
    for one, b, e in zip(alone.tolist(), begin.tolist(), [*begin[1:].tolist(), len(i)]):
        others = j[b:e]
        # sets whose sizes differ too much cannot be similar
        others = others[(label[others] != label[one]) & (size[others] > 0) & ((UP + DOWN) * np.minimum(size[others], size[one]) >= UP * (size[others] + size[one]))]
        inside[ids[at[one] : at[one + 1]]] = 1
        for some in np.array_split(others, 1 + int(size[others].sum()) // limit):
            if len(some):
                n = size[some]
                both = np.add.reduceat(inside[ids[ragged(at[some], n)]], np.cumsum(n) - n)
                some = some[(UP + DOWN) * both >= UP * (n + size[one])]
                heads, first = np.unique(label[some], return_index=True)
                keep_ = heads != label[one]  # those of a part before may have joined it
                out.append(np.stack((np.full(keep_.sum(), one), some[first[keep_]]), axis=1))
                label[np.isin(label, heads)] = label[one]
        inside[ids[at[one] : at[one + 1]]] = 0
    return np.concatenate(out)


def sets_of(texts: DataFrame, named: DataFrame, wanted: DataFrame, size: int, seed: int) -> DataFrame:
    """node, set: the shingles of the wanted nodes (n); named: node and the _digest of one of its texts."""
    wanted = wanted.join(named, F.col("n") == F.col("node")).select("_digest")
    slot = F.pmod(F.col("_digest"), F.lit(FILTER_BITS))
    found = wanted.select((slot / 32).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast(pmod(_digest, {FILTER_BITS}) % 32 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    bits[np.asarray(found["at"])] = np.asarray(found["bits"]).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch["_digest"]) % FILTER_BITS
            some = batch.filter(pa.array(((bits[at // 32] >> (at % 32).astype(np.uint32)) & 1).astype(bool)))
            for part in pieces(iter([some]), limit=1 << 20):
                h, n = shingle_sets(part, size, seed)
                yield pa.RecordBatch.from_arrays([part["_digest"], pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(h.view(np.int64)))], names=["_digest", "set"])

    # the filter lets a few others through; only named texts have a node
    sets = texts.select("text", "_digest").mapInArrow(run, "_digest long, set array<long>").join(named, "_digest").groupBy("node").agg(F.first("set").alias("set"))
    return keep(sets, "sets")


def verified(texts: DataFrame, named: DataFrame, pairs: DataFrame, size: int, seed: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets have at least the similarity."""
    sets = sets_of(texts, named, pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct(), size, seed)
    both = pairs.select("a", "b").join(sets.toDF("a", "one"), "a").join(sets.toDF("b", "two"), "b")
    overlap = F.size(F.array_intersect("one", "two"))
    out = keep(both.where((UP + DOWN) * overlap >= UP * (F.size("one") + F.size("two"))).select("a", "b"), "links")
    discard(sets)
    return out


def in_components(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose nodes are not in one component yet."""
    one, two = found.toDF("a", "_x"), found.toDF("b", "_y")
    both = pairs.join(one, "a", "left").join(two, "b", "left")
    return both.where(F.coalesce("_x", "a") != F.coalesce("_y", "b")).drop("_x", "_y")


def similar_groups(texts: DataFrame, size: int = 5, seed: int = 42, recall: float = 0.95, small: int = SMALL) -> DataFrame:
    """(doc_id, _digest, group) for each row of texts (doc_id, text, _digest): those that links join have one group.

    A link is a Jaccard similarity of at least UP / DOWN between sets of lower-cased word shingles; no other pair
    links, and a pair just at this similarity is found with at least the chance `recall`, closer ones almost surely.
    Texts whose fingerprints are equal in all bits are one node, and so are texts without words. First each node is verified with
    the one of its partners that differs in fewest bits, then its other pairs that these links have not joined, and
    at last all pairs that are still apart: these by the sets of their groups' members, without a row for each pair.
    """
    rows = keep(wide_fingerprints(texts, size, seed), "prints")
    nodes = rows.groupBy("node").agg(F.min("_digest").alias("_digest"), *(F.first(c).alias(c) for c in PRINT))
    nodes = keep(nodes, "nodes")
    blocks, named = Blocks(nodes.count(), recall), nodes.select("node", "_digest")
    met = keep(meetings(keyed(nodes, blocks), blocks, small), "met")
    pairs = met.where("b is not null").select("a", "b", "differ")
    # a pair may come twice where it met by the first and by a following row
    both = pairs.union(pairs.select("b", "a", "differ").toDF("a", "b", "differ"))
    nearest = both.groupBy("b").agg(F.min_by("a", F.struct("differ", "a")).alias("a"))
    nearest = nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = verified(texts, named, keep(nearest, "nearest"), size, seed)
    found = keep(connected_components(links), "components")
    second = keep(in_components(pairs, found).select("a", "b").distinct(), "second")
    if not second.isEmpty():
        links = links.union(verified(texts, named, second, size, seed))
        found = keep(connected_components(links), "components")
    members = met.where("b is null").select("key", "a", *PRINT).distinct()
    placed = members.join(found.toDF("a", "_c"), "a", "left").withColumn("component", F.coalesce("_c", "a")).drop("_c")
    placed = keep(placed, "placed")
    several = placed.groupBy("key").agg(F.min("component").alias("_x"), F.max("component").alias("_y")).where("_x < _y").select("key")
    kinds = ", ".join(f"{c} {dict(_i='int', _j='int', _left='boolean').get(c, 'long')}" for c in DEALT)
    rest = keep(in_groups(placed.join(several, "key", "left_semi"), ["key"], apart(blocks), kinds), "rest")
    if not rest.isEmpty():
        sets = sets_of(texts, named, rest.select(F.col("a").alias("n")).distinct(), size, seed)
        more = in_parts(rest.join(sets.toDF("a", "set"), "a"), ["key"], joined(blocks), "a long, b long").distinct()
        found = connected_components(links.union(keep(more, "more")))
        discard(sets)
    discard(met, placed)
    group = F.coalesce("component", "node").alias("group")
    return rows.select("doc_id", "_digest", "node").join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("doc_id", "_digest", group)
