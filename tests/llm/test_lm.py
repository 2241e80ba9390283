import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from formweave.llm import lm
from formweave.llm.packing import encoder


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def ids_of(t):
    return encoder()(" " + " ".join(words_of(t))).astype(np.int64) if words_of(t) else np.zeros(0, np.int64)


def corpus(n=140):
    rng = random.Random(4)
    vocab = ["the", "Of", "and", "ÉTÉ", "Straße", "token", "x.y", "12", "walking", "slowly", "home"]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 150)) + ([f"rare{i % 50}"] if i % 3 else [])) for i in range(n)]
    return [*texts, None, "", " \n\t", texts[0], "word " * 3000, "blank" + " " * 300_000 + " " * 30_000 + "end"]


def windows(ids):
    out = []
    for x in ids:
        x = [lm.END_ID, lm.END_ID, *x, lm.END_ID]
        out += [(x[s : s + lm.WINDOW + 2] + [-1] * lm.WINDOW)[: lm.WINDOW + 2] for s in range(0, len(x) - 2, lm.WINDOW)]
    return np.array(out)


def small_model(texts, passes=1):
    ids = [ids_of(t) for t in texts]
    counts = np.bincount(np.concatenate(ids), minlength=lm.N_IDS)
    counts[lm.END_ID] += len(ids)
    model = lm.Model(counts)
    losses = [model.train(windows(ids), p / passes, 1 / passes) for p in range(passes)]
    return model, ids, counts, losses


def pairs(given):
    return lm.pair_codes(np.concatenate(([lm.END_ID], given[:-1])), given)


def test_model_is_a_distribution_and_learns():
    model, ids, counts, losses = small_model(corpus()[:140], 4)
    assert losses[-1] < losses[0]
    given = np.concatenate(([lm.END_ID], ids[1][:5]))
    out = model.outputs(given[None], pairs(given)[None], 0)[-1:]
    assert np.allclose(out, model.forward(given[None], pairs(given)[None])["out"][-1:], atol=1e-4)
    logs = model.log_probability(np.repeat(out, lm.N_IDS, axis=0), np.repeat(given[-1:], lm.N_IDS), np.arange(lm.N_IDS))
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)
    unigram = np.log10((counts + 1) / (counts + 1).sum())
    held = [ids_of(t) for t in ("the of and walking slowly home the of", "token 12 x.y and the of walking home")]
    assert all(s > unigram[x].sum() + unigram[lm.END_ID] for s, x in zip(model.score(held), held))


def test_gradients():
    """Against differences of the loss, for every weight and for the tables, head and tail."""
    model, ids, _, _ = small_model(corpus(8)[:8])
    rng = np.random.default_rng(2)
    y = rng.choice(np.concatenate(ids), (3, lm.WINDOW))
    y[0, :3] = [40000, 40001, 12345]
    x = rng.choice(np.concatenate(ids), (3, lm.WINDOW))
    g, wanted = lm.pair_codes(np.roll(x, 1, axis=1), x), np.ones(y.shape, bool)
    wanted[2, 20:] = False
    for t in (model.p, model.rows):
        for k in t:
            t[k] = t[k].astype(np.float64)
    loss = lambda: model.gradients(x, g, y, wanted)[0]
    _, grad, rows = model.gradients(x, g, y, wanted)
    for n, v in model.p.items():
        at = tuple(rng.integers(s) for s in v.shape)
        if n == "m":
            k = int(model.slot[y[1, 1]] // lm.MEMBERS)
            at = (k, *at[1:])
        check(loss, v, at, grad[n][at])
    for n, (index, d) in rows.items():
        i = int(rng.integers(len(index)))
        j = int(np.abs(d[i]).argmax())
        check(loss, model.rows[n], (int(index[i]), j), d[i, j])


def check(loss, v, at, want):
    old, step = v[at], 1e-4
    v[at] = old + step
    up = loss()
    v[at] = old - step
    down = loss()
    v[at] = old
    assert (up - down) / (2 * step) == pytest.approx(want, rel=2e-2, abs=2e-5)


def test_windows_score_each_id_once_with_the_past_alone():
    model, ids, _, _ = small_model(corpus(20)[:20])
    rng = np.random.default_rng(1)
    texts = [rng.choice(np.concatenate([*ids, [40000, 40001]]), n) for n in (0, 1, 22, 23, 24, 25, 43, 44, 45, 46, 47, 200)]
    for text, got in zip(texts, model.score(texts, batch=3)):
        target = np.append(text, lm.END_ID)
        given = np.append(lm.END_ID, text)
        want = 0.0
        for i, y in enumerate(target):
            start = 0 if i < lm.WINDOW else ((i - lm.WINDOW) // lm.STRIDE + 1) * lm.STRIDE
            out = model.outputs(given[start : i + 1][None], pairs(given)[start : i + 1][None], 0)[-1:]
            want += model.log_probability(out, given[i : i + 1], np.array([y]))[0]
        assert got == pytest.approx(want / math.log(10), rel=1e-4)


def test_all_windows_are_drawn_once(spark):
    texts = corpus(30)
    rows = lm.tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2), lm.F.lit(False))
    got = Counter(bytes(r.w) for r in lm.windows_of(rows, 1.0, 0).collect())
    assert got == Counter(w.astype("<i4").tobytes() for w in windows([ids_of(t) for t in texts]))
    some = [{bytes(r.w) for r in lm.windows_of(rows, 0.3, s).collect()} for s in (1, 2)]
    assert some[0] != some[1] and all(0.1 * len(got) < len(x) < 0.6 * len(got) for x in some)


def test_every_window_is_trained_on(spark, monkeypatch):
    """Rounds share out all windows: each is in one of them, none in several but by rounding."""
    monkeypatch.setattr(lm, "WINDOW", 4)
    drawn = []
    monkeypatch.setattr(lm, "improve", lambda model, windows, *a: drawn.append(Counter(bytes(r.w) for r in windows.collect())))
    texts = [f"{i} one two three four five six seven" for i in range(300)]
    rows = lm.tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2), lm.F.lit(False))
    lm.fit(rows, rounds=3, least=10)
    want = Counter(w.astype("<i4").tobytes() for w in windows([ids_of(t) for t in texts]))
    assert len(drawn) == 3 and sum(drawn, Counter()) == want
    assert all(0.2 < sum(x.values()) / sum(want.values()) < 0.5 for x in drawn)
    drawn.clear()
    lm.fit(rows, rounds=3, least=10**6)
    assert drawn == [want] * 3


def test_counts_of_successive_ids():
    ids, offsets = np.array([5, 7, 5, 9], np.uint16), np.array([0, 3, 3, 4])
    slot = np.arange(lm.N_IDS) % lm.HEAD
    want = [(0, 5), (5, 7), (7, 5), (5, 0), (0, 0), (0, 9), (9, 0)]
    assert lm.following(slot)(ids, offsets).tolist() == [a * lm.HEAD + b for a, b in want]


def test_rows_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAVY", 8)
    monkeypatch.setattr(lm, "REPLICA_WINDOWS", 100)
    texts = corpus()
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "the end")]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    got = lm.lm_scores(df.repartition(3), rounds=2).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update([*words_of(t), None])
    total, kinds = sum(c.values()), len(c)
    want = Counter()
    for i, t in rows:
        w = [*words_of(t), None]
        base = sum(math.log10((c[x] + 1) / (total + kinds + 1)) for x in w)
        want[i, held(i), len(w), sum(c[x] > 0 for x in w), total, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert len({round(r.score, 3) for r in got if r.doc_id == 3}) == 1


def test_held_out_texts_of_the_tables_against_the_word_base(spark):
    """1000 documents teach enough to draw level with the base, which gives all unseen words one share; more do better."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)
    held = [r for r in lm.lm_scores(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > 1.02 * sum(r.base_score for r in held)
    assert sum(r.score > r.base_score for r in held) > 0.4 * len(held)


def test_no_rows(spark):
    assert lm.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tokens_spell_the_tidy_text(spark):
    texts = ["  A  b\n", None, "c Été \U0001f642 x", ""]
    rows = lm.tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), lm.F.lit(False)).orderBy("doc_id").collect()
    column = pa.array([bytes(r.ids) for r in rows], pa.binary())
    ids, offsets = lm.id_rows(column)
    data, at = lm.spelled(ids, offsets)
    assert [data[s:e].decode() for s, e in zip(at, at[1:])] == [" a b", "", " c Été \U0001f642 x", ""]
