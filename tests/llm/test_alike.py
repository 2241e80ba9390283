import random
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from formweave.llm import alike
from formweave.llm.components import in_groups

from .test_simhash import words_of


def shingles(text):
    w = words_of((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def similar(a, b):
    return 9 * len(a & b) >= 4 * (len(a) + len(b))


def groups(texts):
    sets, label = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for i in texts:
            for j in texts:
                if label[j] < label[i] and similar(sets[i], sets[j]):
                    label[i], changed = label[j], True
    return label


def corpus():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    line = [word() for _ in range(25)]
    texts, at = {}, 0
    for k in range(60):
        base = [word() for _ in range(rng.randint(3, 200))] + (line if k % 2 else [])
        for change in range(rng.choice([1, 4])):
            copy = list(base)
            for _ in range(change * len(base) // 90):
                copy[rng.randrange(len(copy))] = word()
            texts[at := at + 1] = " ".join(copy)
    texts |= {900: None, 901: "", 902: "one two", 903: "ONE  two", 904: texts[9].upper()}
    chain = [word() for _ in range(120)]
    for k in range(12):  # each like the next, the ends unlike
        texts[950 + k] = " ".join(chain[5 * k : 5 * k + 60])
    return texts


@pytest.mark.parametrize(("part_rows", "small"), [(1024, alike.SMALL), (3, 2)])
def test_near_copies_go_whatever_words_changed(spark, tmp_path, monkeypatch, part_rows, small):
    monkeypatch.setattr(alike, "in_groups", lambda *a: in_groups(*a, part_rows))
    monkeypatch.setattr(corpus_pipeline, "similar_groups", partial(alike.similar_groups, small=small))
    texts = corpus()
    label = groups(texts)
    sets = {i: shingles(t) for i, t in texts.items()}
    between = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in texts for j in texts if i < j and sets[i] and sets[j]]
    assert sum(0.8 <= x < 0.9 for x in between) >= 20 and sum(0.9 <= x < 0.95 for x in between) >= 10 and sum(0.6 <= x < 0.8 for x in between) >= 20
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, df, str(tmp_path)).collect()
    assert all(r.text == texts[r.doc_id] for r in got)
    kept, first = Counter(r.doc_id for r in got), set(label.values())
    assert first <= set(kept) and max(kept.values()) == 1
    assert len(kept) <= len(first) + 2  # blocks are enough for nearly all pairs just at the similarity


def test_blocks_find_pairs_at_the_similarity():
    """Share of pairs of random fingerprints that differ as pairs at the least similarity do and share a block."""
    rng = np.random.default_rng(1)
    for count in (100, 100_000, 10**8):
        blocks = alike.Blocks(count)
        differ = np.packbits(rng.random((4000, 64 * alike.WORDS)) < blocks.share, axis=1, bitorder="little").view(np.uint64)
        found = blocks.first_shared(differ) < len(blocks.places)
        few = np.bitwise_count(differ).sum(axis=1) <= blocks.distance
        assert (found & few).mean() > 0.94
        one = rng.integers(0, 1 << 63, (50, alike.WORDS), dtype=np.uint64)
        keys = blocks.keys(one), blocks.keys(one ^ differ[:50])
        same = keys[0] == keys[1]
        assert (np.where(same.any(axis=1), same.argmax(axis=1), len(blocks.places)) == blocks.first_shared(differ[:50])).all()


def test_fingerprints_differ_as_the_similarity_says(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for _ in range(200):
        a = [word() for _ in range(200)]
        texts.append((" ".join(a), " ".join([word() for _ in range(22)] + a[22:])))
    df = spark.createDataFrame([(2 * i + j, t, 2 * i + j) for i, two in enumerate(texts) for j, t in enumerate(two)], "doc_id long, text string, _digest long")
    prints = {r.doc_id: [r[c] for c in alike.PRINT] for r in alike.wide_fingerprints(df, 5, 42).collect()}
    bits = [sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(prints[2 * i], prints[2 * i + 1])) for i in range(len(texts))]
    assert abs(np.mean(bits) / (64 * alike.WORDS) - alike.Blocks(100).share) < 0.02


def test_a_group_of_near_copies_makes_few_pairs_for_each(spark):
    """Pairs and rows kept for later grow with the members of groups, and together name every near pair."""
    rng = np.random.default_rng(4)
    blocks = alike.Blocks(4000)
    base = rng.integers(0, 1 << 63, alike.WORDS, dtype=np.uint64)

    def copies(n):
        flips = np.packbits(rng.random((n, 64 * alike.WORDS)) < 0.01, axis=1, bitorder="little").view(np.uint64)
        return base ^ flips

    prints = np.concatenate((copies(60), rng.integers(0, 1 << 63, (300, alike.WORDS), dtype=np.uint64)))
    nodes = spark.createDataFrame([tuple(int(x) for x in p.view(np.int64)) for p in prints], ", ".join(f"{c} long" for c in alike.PRINT))
    got = alike.meetings(alike.keyed(nodes, blocks), blocks, 64).collect()
    pairs = [(r.a, r.b) for r in got if r.b is not None]
    assert len(pairs) < 10 * 60
    names, named, members = alike.node_of(prints).tolist(), set(pairs), {}
    for r in got:
        if r.b is None:
            members.setdefault(r.key, set()).add(r.a)
    keys = blocks.keys(prints)
    for i in range(60):
        differ = prints[i] ^ prints[i + 1 : 60]
        first = blocks.first_shared(differ)
        for j, t in zip(range(i + 1, 60), first.tolist()):
            if t < len(blocks.places):
                pair = tuple(sorted((names[i], names[j])))
                assert pair in named or {*pair} <= members.get(int(keys[i, t]), set())


def test_members_still_apart_are_few_rows_and_their_sets_join_them():
    """Many near prints of different components: no row for each pair, and the joining pairs give all components."""
    rng = np.random.default_rng(6)
    blocks, n = alike.Blocks(4000), 120
    prints = rng.integers(0, 1 << 63, alike.WORDS, dtype=np.uint64) ^ np.packbits(rng.random((n, 64 * alike.WORDS)) < 0.005, axis=1, bitorder="little").view(np.uint64)
    key, node = blocks.keys(prints)[:, 0], rng.permutation(n)
    some = np.flatnonzero(key == key[0])
    # sets of which each is like the next of its stretch of 12 and too unlike those after
    sets = [np.arange(100 * (i // 12) * 100 + 10 * (i % 12), 100 * (i // 12) * 100 + 10 * (i % 12) + 100) for i in range(n)]
    columns = {"key": key[some], "a": node[some], "component": node[some], **{c: prints[some, w].view(np.int64) for w, c in enumerate(alike.PRINT)}}
    columns |= {"set": [sets[i] for i in some], "_i": np.zeros(len(some), np.int32), "_j": np.zeros(len(some), np.int32), "_left": np.ones(len(some), bool)}
    table, bounds = pa.table(columns), np.array([0, len(some)])
    assert len(some) > 60
    assert sorted(x for b in alike.apart(blocks)(table, bounds) for x in b["a"].to_pylist()) == sorted(node[some].tolist())
    got = [(a, b) for batch in alike.joined(blocks)(table, bounds) for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist())]
    of = dict(zip(node[some].tolist(), some.tolist()))
    like = lambda i, j: similar(set(sets[i].tolist()), set(sets[j].tolist()))
    assert len(got) < len(some) and all(like(of[a], of[b]) for a, b in got)
    label, want = {int(i): int(i) for i in some}, {int(i): int(i) for i in some}
    for names, pairs in ((label, [(of[a], of[b]) for a, b in got]), (want, [(int(i), int(j)) for i in some for j in some if like(i, j)])):
        for _ in range(n):
            for a, b in pairs:
                names[a] = names[b] = min(names[a], names[b])
    assert label == want and 1 < len(set(label.values())) < len(some)


def test_joining_in_parts_of_any_size():
    at = np.array([0, 5, 10, 15, 15])
    values = np.array([1, 2, 3, 4, 5, 1, 2, 3, 4, 6, 1, 2, 3, 4, 5])
    pairs = np.array([0, 0, 0, 1, 1, 2]), np.array([1, 2, 3, 2, 3, 3])
    for limit in (1, 6, 1 << 20):
        got = alike.joining(np.array([7, 8, 9, 10]), values, at, *pairs, limit)
        assert got.tolist() == [[0, 2]]
