import hashlib
import random
import re
from collections import Counter

from formweave.llm.debruijn import remove_repeats, repeated_paths
from formweave.llm.suffixes import repeated_passages


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def covered(texts, n):
    counts = Counter(tuple(w[i : i + n]) for w in map(words_of, texts) for i in range(len(w) - n + 1))
    out = []
    for w in map(words_of, texts):
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if counts[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        out.append(gone)
    return out


def corpus(n):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(300)] + ["été", "Straße", "x|y"]
    fresh = lambda k: " ".join(rng.choices(vocab, k=k))
    passages = [fresh(k) for k in (n - 1, n, n + 1, 2 * n, 5 * n)]
    texts = []
    for i in range(70):
        t = fresh(rng.randint(0, 90))
        for p in rng.sample(passages, rng.randint(0, 2)):
            w = p.split(" ")
            a, b = (0, len(w)) if rng.random() < 0.5 else sorted(rng.sample(range(len(w) + 1), 2))
            t += "\n" + "  ".join(w[a:b]) + " " + fresh(rng.randint(0, 20))
        texts.append(t)
    texts += [texts[3], texts[3] + " tail", "tail " + texts[4], None, "", " \n", "same " * (3 * n), "a b " * n, texts[0][: len(texts[0]) // 2]]
    loop = fresh(2 * n)
    return [*texts, loop + " " + loop, fresh(30000) + " " + loop]


def frame(spark, texts):
    rows = [(None if i == 5 else i, t, "x", 1) for i, t in enumerate(texts)] + [(2, texts[2], "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, n_words int"), [*texts, texts[2]], [r[0] for r in rows]


def test_de_bruijn_removal_equals_brute_force(spark):
    for n, k in ((35, 12), (12, 5)):
        df, texts, ids = frame(spark, corpus(n))
        want = Counter()
        for i, t, gone in zip(ids, texts, covered(texts, n)):
            kept = " ".join(w for w, g in zip(words_of(t), gone) if not g)
            want[i, len(gone), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
        assert Counter(map(tuple, remove_repeats(df.repartition(3), n, k).collect())) == want
    assert remove_repeats(df.limit(0)).count() == 0


def test_paths_of_a_shared_passage_have_one_name(spark):
    rng = random.Random(1)
    fresh = lambda: " ".join(f"v{rng.randrange(10**6)}" for _ in range(60))
    shared = fresh() + " " + fresh()
    df = spark.createDataFrame([(i, f"{fresh()} {shared} {fresh()}") for i in range(6)], "doc_id long, text string")
    rows = repeated_paths(df).collect()
    assert len(rows) == 6
    for r in rows:
        assert min(p.begin for p in r.paths) == 60 and max(p.end for p in r.paths) == 180
    middle = {max(r.paths, key=lambda p: p.end - p.begin).path for r in rows}
    assert len(middle) == 1


def test_suffix_array_passages_equal_brute_force(spark):
    for n, k in ((50, 18), (15, 6)):
        df, texts, ids = frame(spark, corpus(n))
        want = Counter()
        for i, gone in zip(ids, covered(texts, n)):
            if any(gone):
                want[i, sum(gone)] += 1
        for parts in (1, 7):
            got = repeated_passages(df.repartition(parts), n, k).collect()
            assert Counter((r.doc_id, r.n_repeated) for r in got) == want
            assert all(b.begin >= a.end for r in got for a, b in zip(r.passages, r.passages[1:]))
    assert repeated_passages(df.limit(0)).count() == 0
