import random
import re
from collections import Counter

import pytest

from formweave.llm.phrases import collocations, frequent_grams

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def gram_counts(docs, longest=4):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    return f, n


def brute(docs, least, longest=4, best=2000, inside=80):
    f, n = gram_counts(docs, longest)
    often = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    out = []
    for lang in n:
        mine = []
        for (x, w), a in often.items():
            if x != lang or any(y == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) and 100 * b >= inside * a for (y, v), b in often.items()):
                continue
            score, k = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            mine.append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(mine)[:best])]
    return sorted(out)


def frame(spark, docs):
    return spark.createDataFrame(docs, "text string, lang string")


def result(spark, docs, **more):
    return sorted(tuple(r) for r in collocations(frame(spark, docs), **more).collect())


def some_docs(rng, n=80):
    words = ["Alpha", "beta", "GAMMA", "de", "Ünï", "x y", "über", "z-9"]
    marks = [" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b", " ! "]
    phrase = ["one two three four", "one two three", "red  fish", "three four five six seven"]
    text = lambda: "".join((rng.choice(words) if rng.random() < 0.6 else rng.choice(phrase)) + rng.choice(marks) for _ in range(rng.randint(0, 60)))
    return [(text(), rng.choice(["en", "en", "fr", None, "und"])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("buckets", (1 << 12, 1 << 16))
def test_rows_equal_brute_force(spark, seed, buckets):
    docs = some_docs(random.Random(seed)) + [(None, "en"), ("", "en"), (None, "xx"), ("one two " * 4000, "fr")]
    docs += docs[:9]
    got = result(spark, docs, least=7, buckets=buckets)
    assert got == brute(docs, 7) and len(got) > 30
    assert {r[0] for r in got} == {"en", "fr", "und"}


def test_ranks_end_at_the_number_asked_for(spark):
    docs = some_docs(random.Random(5))
    got = result(spark, docs, least=5, best=4)
    assert got == brute(docs, 5, best=4) and max(r[1] for r in got) == 4


def test_longer_and_shorter_phrases_and_other_shares(spark):
    docs = some_docs(random.Random(6), 40)
    for longest, inside in ((2, 80), (3, 50), (5, 100)):
        assert result(spark, docs, least=5, longest=longest, inside=inside) == brute(docs, 5, longest, inside=inside)


def test_counts_are_exact_though_buckets_are_shared(spark):
    docs = [(" ".join(f"w{i % 700}" for i in range(j, j + 1500)), "en") for j in range(40)]
    f, n = gram_counts(docs)
    got = {(r.lang, r.k, r.gram): r.n for r in frequent_grams(frame(spark, docs), 30, buckets=1 << 12).collect()}
    want = {(x, len(w), " ".join(w)): a for (x, w), a in f.items() if a >= 30} | {(x, 0, ""): a for x, a in n.items()}
    assert got == want


def test_a_high_least_count(spark):
    docs = [("a b c. " * 200, "en"), ("a b " * 100, "en")]
    assert result(spark, docs, least=300) == brute(docs, 300) and result(spark, docs, least=3000) == []


def test_empty_tables_and_clashing_columns(spark):
    assert result(spark, []) == [] and result(spark, [(None, None), ("a", "en")]) == []
    docs = spark.createDataFrame([("a b", "en", 1, "g", 2, 3)] * 40, "text string, lang string, n int, gram string, k int, span int")
    assert [tuple(r) for r in collocations(docs).collect()] == [("en", 1, "a b", 40, 40, 40, 80, 1000000)]


def test_counts_beyond_64_bit_products(spark):
    # 2 000 000 * a passes 64 bits from about 4.6e12 on; the score is taken from decimals.
    row = spark.sql("SELECT cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(l as decimal(20,0))) AS s FROM VALUES (9000000000000000000, 9000000000000000001) AS t(a, l)").first()
    assert row.s == 2000000 * 9000000000000000000 // (2 * 9000000000000000001)
