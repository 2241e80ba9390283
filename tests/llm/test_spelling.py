import random
import re
import zlib
from collections import Counter

import pytest

from formweave.llm.spelling import Shard, hot_parts, near_words, parts, roots, spelling_variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(docs, least=3):
    c = Counter()
    for doc, text in docs:
        for r in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            r = r.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{r}".encode())
            c[r[: h % len(r)] + r[h % len(r) + 1 :] if h % 97 == 0 else r] += 1
    return {w: n for w, n in c.items() if len(w) >= 5 and n >= least}


def brute(docs, least=3):
    words = brute_words(docs, least)
    out = {}
    for w, n in words.items():
        near = [v for v in words if one_apart(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        out[w] = (best if best and words[best] >= 2 * n else None, n, len(near))
    rows = set()
    for w, (form, n, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, k, words[form] if form else None))
    return rows


def result(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return [tuple(r) for r in spelling_variants(df, **more).select("word", "form", "root", "n", "n_near", "form_n").collect()]


def some_docs(rng, n=150, letters="abé"):
    stock = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(120)]
    word = lambda: stock[int(120 * rng.random() ** 4)]
    return [(i, rng.choice([" ", "-", "7"]).join(word().upper() if rng.random() < 0.2 else word() for _ in range(rng.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_rows_equal_brute_force(spark, seed):
    docs = some_docs(random.Random(seed)) + [(900, None), (901, ""), (None, "Straße straßen straße straße"), (902, "x" * 3000 + " " + "x" * 2999 + " "), (902, ("x" * 3000 + " ") * 3), (903, ("x" * 2999 + " ") * 7)]
    docs += docs[:5]
    got = result(spark, docs)
    assert len(got) == len(set(got)) and set(got) == brute(docs)
    assert any(r[1] for r in got) and any(r[2] not in (r[0], r[1]) for r in got)


def test_parts_that_too_many_words_share_are_cut_again(spark):
    rng = random.Random(9)
    words = {"common" + "".join(rng.choice("abcdef") for _ in range(rng.randint(4, 6))) for _ in range(600)}
    words |= {"".join(rng.choice("abcdef") for _ in range(rng.randint(4, 6))) + "common" for _ in range(300)}
    words = {w: rng.randint(3, 9) for w in words}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    hot = hot_parts(df, largest=20)
    assert len(hot) > 10
    asked = Counter(k for w in words for m in (len(w) - 1, len(w), len(w) + 1) for k, a, b in parts(w, m, hot) if b - a > 1)
    assert max(asked.values()) <= 20 or not {k for k, n in asked.items() if n > 20} & {k for w in words for k, _, _ in parts(w, len(w), hot)}
    got = {r.word: (r.n, r.n_near, r.form_n, r.form) for r in near_words(df, largest=20, shard=50).collect()}
    for w, n in words.items():
        near = [v for v in words if one_apart(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        assert got[w] == (n, len(near), words.get(best), best)


def test_each_pair_is_found_once_by_any_cut():
    rng = random.Random(4)
    words = list({"".join(rng.choice("ab") for _ in range(rng.randint(5, 8))) for _ in range(200)})
    for hot in (frozenset(), frozenset(k for w in words[::2] for k, _, _ in parts(w, len(w), frozenset()))):
        shard = Shard([(w, 3, a, b) for w in words for _, a, b in parts(w, len(w), hot)])
        v, rows = shard.near(words)
        pairs = [(words[i], shard.words[j]) for i, j in zip(v.tolist(), rows.tolist())]
        assert len(pairs) == len(set(pairs)) and set(pairs) == {(x, y) for x in words for y in words if one_apart(x, y)}


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}" if i < 20 else None) for i in range(21)] + [("alone", None)]
    got = {r.word: r.root for r in roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {f"w{i}": "w20" for i in range(21)} | {"alone": "alone"}


def test_empty_tables_and_clashing_columns(spark):
    assert result(spark, []) == [] and result(spark, [(1, None), (2, "a b c")]) == []
    docs = spark.createDataFrame([(1, "words words words", 5, "x", 1)], "doc_id long, text string, n long, word string, k long")
    assert [tuple(r) for r in spelling_variants(docs).collect()] in ([("words", None, "words", 3, 0, None)], [])
