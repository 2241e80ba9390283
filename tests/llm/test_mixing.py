import random
import re
from collections import Counter

import numpy as np
import pytest

from formweave.llm.mixing import Shards, mix_documents, permuted, taken_by, taken_words, targets


def count(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_targets_share_by_weight_up_to_twice_the_size():
    sizes = {"b": 100, "a": 10, None: 500, "c": 0}
    t = targets(sizes)
    assert sum(t.values()) == pytest.approx(1.5 * 610) and t["a"] == 20 and t["c"] == 0
    assert all(v <= 2 * sizes[s] + 1e-9 for s, v in t.items())
    assert targets({"a": 8, "b": 8, "c": 8}) == {"a": 16, "b": pytest.approx(40 / 3), "c": pytest.approx(20 / 3)}
    assert targets({}) == {} and targets({None: 0}) == {None: 0}


def test_draws_use_up_quotas_and_permutations_are_bijections():
    q = np.array([5, 0, 1000, 37])
    shards = Shards(q, 64, 3)
    d = np.array([shards[k][0] for k in range(shards.count)])
    assert (d.sum(axis=0) == q).all() and (d.sum(axis=1)[:-1] == 64).all() and shards.count == 17
    assert [shards[k][1] for k in range(17)] == (np.cumsum(d, axis=0) - d).tolist()
    assert Shards(q, 64, 3)[9] == shards[9] and Shards(q, 64, 4)[9] != shards[9]
    assert Shards(np.array([0]), 8, 1).count == 0
    # a source's share of a shard varies as a draw without replacement does
    x = np.array([Shards(np.array([600, 400]), 100, s)[3][0][0] for s in range(400)])
    assert abs(x.mean() - 60) < 1 and 0.7 < x.var() / (100 * 0.6 * 0.4 * 900 / 999) < 1.35
    rng = np.random.default_rng(1)
    assert abs(np.mean([taken_by(6 * 10**11, 10**12, 10**6, rng) for _ in range(300)]) - 6e5) < 200
    for n in (1, 2, 3, 100, 1000):
        assert sorted(permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    assert (permuted(np.arange(1000), 1000, 5) != permuted(np.arange(1000), 1000, 6)).any()


def corpus():
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices("abcdefg", k=rng.randint(1, 400))), rng.choice(["s0", "s0", "s1", "s2", None])) for i in range(150)]
    return rows + [(900, None, "s1"), (900, None, "s1"), (901, "", "s9"), (902, "x y", "s3"), (902, "x y", "s3"), (None, "q r s", None), (903, "w " * 20000, "s2")]


def test_taken_words(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, size string")
    got = taken_words(df, block_words=16).collect()
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((i, count(t), s) for i, t, s in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += count(t)
    goal, taken = targets(dict(sizes)), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == goal[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 32 for s in sizes)
    again = taken_words(df.repartition(3), block_words=16).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in got)
    # the mixed documents hold just these words
    mixed = mix_documents(df, block_words=16)
    assert mixed.columns == df.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id, r.source] += count(r.text)
    want = Counter()
    for r in got:
        want[r.doc_id, r.source] += r.taken
    assert words == +want


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert taken_words(df).count() == 0 and mix_documents(df).count() == 0
