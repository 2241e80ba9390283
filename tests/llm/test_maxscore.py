import math
import random

import pytest

from formweave.llm.maxscore import top_k


def brute(rows, queries, k):
    ok = {}
    for n, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok[n] = (i, [math.floor(1024 * x) for x in v])
    out = []
    for q, v in {(i, tuple(v)) for i, v in ok.values() if i in queries}:
        best = sorted((-sum(a * b for a, b in zip(v, u)), i) for i, u in ok.values() if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["gauss", "few", "negative"])
def test_equals_brute_force(spark, kind):
    rng = random.Random(kind)
    make = {"gauss": lambda: rng.gauss(0, 0.2), "few": lambda: rng.choice([0.0, 0.0, 0.25, -0.5]), "negative": lambda: -abs(rng.gauss(0, 0.2))}[kind]
    rows = [(i, [make() for _ in range(16)]) for i in range(180)]
    rows += [(200, rows[0][1]), (300, rows[0][1]), (301, None), (302, [None] * 16), (303, [float("nan")] * 16), (304, [float("inf")] * 16), (305, [0.5] * 3), (306, []), (None, [0.1] * 16), (7, rows[7][1])]
    if kind == "negative":
        rows[100] = (100, [abs(x) for x in rows[100][1]])
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string")
    got = top_k(df, df.where("vec_id % 50 = 0"), k=7, shard_rows=64, query_rows=2)
    assert sorted(map(tuple, got.collect())) == brute(rows, {0, 50, 100, 150, 200, 300}, 7)


def test_fewer_rows_than_k_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-3.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, top_k(df, df.where("vec_id = 0")).collect())) == [(0, 1, 1, 2048 * 1024), (0, 2, 2, -3072 * 1024)]
    assert top_k(df.limit(0), df.limit(0)).count() == 0


def test_large_components_and_long_vectors(spark):
    rng = random.Random(2)
    rows = [(0, [300000.0, 1.0]), (1, [300000.0, 2.0]), (2, [299999.0, 2000.0]), (3, [-2.5e6, 5.0]), (4, [1e6, -1e6]), (5, [3e6, 0.25]), (6, [0.5]), (7, [rng.gauss(0, 1) for _ in range(5000)])]
    rows += [(i, [rng.uniform(-1, 1) * 10.0 ** rng.randint(0, 6) for _ in range(6)]) for i in range(10, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for ids in ([0, 1, 2], [3, 5, 7], [6, 10, 20, 30]):
        want = brute(rows, set(ids), 10)
        assert all(abs(s) < 2**63 for *_, s in want)
        assert sorted(map(tuple, top_k(df, df.where(f"vec_id in ({','.join(map(str, ids))})"), shard_rows=16).collect())) == want
    far = spark.createDataFrame([(0, [1e300, 1.0]), (1, [-1e300, 1.0]), (2, [1e300, 1.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in top_k(far, far.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 2, 2**63 - 1), (0, 2, 3, 1024 * 1024), (0, 3, 1, 1 - 2**63)]
