import numpy as np

import pytest

from formweave.llm import collisions
from formweave.llm.collisions import Sorts, at_least, embedding_near_dedup, within


def brute(ids, x):
    with np.errstate(all="ignore"):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.nan_to_num(u @ u.T) >= 0.9
    np.fill_diagonal(near, False)
    label = np.array(ids)
    for _ in ids:
        label = np.minimum(label, np.where(near, label[None], 1 << 60).min(axis=1))
    return {i: (int(n), int(c)) for i, n, c in zip(ids, near.sum(axis=1), label)}, near


def fixture(n=700, dim=32):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((n, dim))
    for i in range(0, n // 2):  # copies at many distances around the threshold, in small and large groups
        c = rng.standard_normal(dim)
        base = x[n // 2 + (i % 7 if i < 200 else i)]
        x[i] = base / np.linalg.norm(base) + rng.choice([0.02, 0.1, 0.2, 0.3]) * c / np.linalg.norm(c)
    x[5] = x[6] * 3
    x[10:20] = x[10]
    x[30] = 0
    return [int(i) for i in rng.permutation(n)], x


@pytest.mark.parametrize(("cell", "part"), [(512, 2048), (40, 30), (6, 2048)])
def test_recall_and_no_wrong_links(spark, monkeypatch, cell, part):
    monkeypatch.setattr(collisions, "CELL_ROWS", cell)
    monkeypatch.setattr(collisions, "PART_ROWS", part)
    ids, x = fixture()
    rows = [(i, v.tolist(), 1, 7) for i, v in zip(ids, x)]
    rows += [(9001, None, 1, 0), (9002, [], 1, 0), (9003, [None] * 32, 0, 0), (9004, [float("nan")] * 32, 0, 0), (9005, [1.0, 2.0], 0, 0), (None, x[0].tolist(), 0, 0), rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links int")
    want, near = brute(ids, x)
    got = {r.vec_id: r for r in embedding_near_dedup(df).collect()}
    assert len(got) == len(ids) + 5
    assert all(got[i].n_links <= want[i][0] for i in ids)
    assert sum(got[i].n_links for i in ids) >= 0.95 * sum(n for n, _ in want.values())
    assert sum(got[i].component_id == want[i][1] for i in ids) >= 0.95 * len(ids)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in (9001, 9002, 9003, 9004, 9005, ids[30]))
    copies = [ids[i] for i in range(10, 20)]
    assert len({(got[i].n_links, got[i].component_id) for i in copies}) == 1 and got[copies[0]].n_links >= 9
    assert embedding_near_dedup(df.limit(0)).count() == 0


def test_calibration():
    for count in (100, 50_000, 10**9):
        sorts, d = Sorts(count, 0.9, 0.95), np.sqrt(0.2)
        meet = within(sorts.wide, d) * (1 - np.arccos(0.9) / np.pi) ** sorts.bits
        misses = (1 - meet) ** sorts.tables + (1 - at_least(8, sorts.first, within(sorts.narrow, d))) + (1 - at_least(32, sorts.both, within(sorts.narrow, d)))
        assert misses <= 0.05 + 1e-9 and sorts.first >= 4 and sorts.both >= 24
    # pairs that meet, as a share of all: it falls with the number of vectors
    share = [s.tables * within(s.wide, np.sqrt(2)) / 2**s.bits for s in (Sorts(n, 0.9, 0.95) for n in (500, 50_000, 10**6, 10**9))]
    assert share[1] < 0.06 and share[2] < 0.006 and share[3] < 1e-4
