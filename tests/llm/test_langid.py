import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from formweave.llm.langid import identify, in_fold, learned_from

WORDS = {"aa": ["der", "und", "ßtraße", "zwölf"], "bb": ["the", "and", "of", "with"], "cc": ["les", "été", "dans", "qui"]}


def rows(n=120):
    rng = random.Random(1)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randint(1, 60))) + rng.choice([".", " 12", "!!", "\n"]), lang))
    return out


def brute_grams(text):
    clean = "".join(c.lower() if c.isalpha() else " " for c in text)
    padded = " " + " ".join(clean.split()) + " " if clean.split() else ""
    g = [padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)]
    return Counter(x for x in g if x != " " and " " not in x[1:-1])


def brute_profile(counts, size=300):
    # codes order n-grams as tuples of code points padded with zeros
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], [ord(c) for c in x[0]]))[:size]]


def brute_predict(text, profiles, size=300):
    mine = brute_profile(brute_grams(text or ""))
    if not mine or not profiles:
        return "und", 0.0
    best = None
    for lang in sorted(profiles):
        place = {g: i for i, g in enumerate(profiles[lang])}
        d = sum(abs(place[g] - i) if g in place else size for i, g in enumerate(mine))
        if best is None or d < best[0]:
            best = (d, lang)
    return best[1], 1 - best[0] / (size * len(mine))


def test_equals_brute_force(spark):
    data = rows() + [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !!", None), (1003, "the of", None), (1004, "und der " * 20000, None), (1005, "the of", None)]
    df = spark.createDataFrame([(i, t, x, 0.5) for i, t, x in data], "doc_id long, text string, lang string, score double")
    totals = {}
    for i, t, x in data:
        if x and t is not None and zlib.crc32(str(i).encode()) % 5:
            totals.setdefault(x, Counter()).update(brute_grams(t))
    profiles = {x: brute_profile(c) for x, c in totals.items()}
    got = {r.doc_id: r for r in identify(df, learned_from(df)).collect()}
    for i, t, _ in data:
        lang, score = brute_predict(t, profiles)
        assert (got[i].lang_pred, got[i].score) == (lang, pytest.approx(score)), i
    held = [(got[i].lang_pred == x) for i, t, x in data if x and t and zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(held) >= 0.95 * len(held)
    assert df.where(in_fold(F.col("doc_id"), 5, 0)).count() == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in data)


def test_nothing_learned_and_no_rows(spark):
    df = spark.createDataFrame([(None, "abc", None), (2, None, "xx")], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in identify(df, learned_from(df)).collect()] == [("und", 0.0)] * 2
    assert identify(df.limit(0), {}).count() == 0
