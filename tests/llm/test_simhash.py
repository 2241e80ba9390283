import random
import re

import xxhash

from formweave.llm.simhash import near_groups, one_of_each, simhash_near_dedup


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_print(text):
    w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_groups(prints, distance=4):
    """The smallest id reachable, from all pairs."""
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i, p in prints.items():
            for j, q in prints.items():
                if (p ^ q).bit_count() <= distance and label[j] < label[i]:
                    label[i] = label[j]
                    changed = True
    return label


def corpus():
    rng = random.Random(3)
    vocab = ["Alpha", "beta", "GAMMA", "Ünder", "straße", "x", "été", "42", "to", "the"]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(1, 80))) for _ in range(60)]
    texts += [t.replace(" ", "  \n", 1) for t in texts[:10]] + [t + " tail" for t in texts[10:30]]
    return [*texts, None, "", " \t\n ", "one", "one two three", "ONE two three", texts[0], "a b c d " * 4000]


def test_fingerprints_and_groups_equal_brute_force(spark):
    texts = corpus()
    rows = [(i, t, "de", f"s{i % 3}", "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, fp string, component_id string")
    got = {r.doc_id: r for r in simhash_near_dedup(df).collect()}
    want = {i: brute_print(t) for i, t in enumerate(texts)}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == want
    assert {i: r.component_id for i, r in got.items()} == brute_groups(want)


def test_links_at_every_distance_and_in_large_groups(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = {}
    for i in range(300):
        p = base if i % 3 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randint(0, 6)):
            p ^= 1 << b
        prints[i * 7] = p
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()], "doc_id long, fp long")
    want = brute_groups(prints)
    for part_rows in (1024, 16):
        from formweave.llm import components, simhash

        def small(members, key, compare, schema, n=part_rows):
            return components.in_groups(members, key, compare, schema, n)

        keep, simhash.in_groups = simhash.in_groups, small
        try:
            assert {r.doc_id: r.component_id for r in near_groups(df).collect()} == want
        finally:
            simhash.in_groups = keep


def test_null_ids_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (4, "a b"), (4, "a b"), (None, "zz yy xx ww vv uu")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in simhash_near_dedup(df).collect()) == [(0, 0), (0, 4), (4, 4), (4, 4)]
    assert simhash_near_dedup(df.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    texts = corpus()
    rows = [(i, t, "de", len(t or "")) for i, t in enumerate(texts)] + [(3, texts[3], "de", 9), (None, texts[4], "x", 1), (None, "never seen words before these", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    want = {i for i, c in brute_groups({i: brute_print(t) for i, t in enumerate(texts)}).items() if i == c}
    out = one_of_each(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in out.collect()) == sorted([-1, *want])
    assert one_of_each(df.limit(0)).count() == 0


def test_clashing_columns_come_back_as_they_are(spark):
    names = ["_digest", "_id", "_of", "_n", "group", "_rest", "fp", "component_id"]
    rows = [(1, "a b c d e", *"abcdefgh"), (2, "a b c d e", *"ijklmnop"), (3, None, *"qrstuvwx")]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    assert sorted(map(tuple, one_of_each(df).collect())) == [rows[0], rows[2]]
