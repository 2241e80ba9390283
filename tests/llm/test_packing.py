import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from formweave.llm.packing import best_fit, best_fit_packing, configurations, encoder, fractional, price, rounded

tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
tokenizer.encode_special_tokens = True


def ids_of(t):
    return [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]


def test_ids_equal_those_of_the_tokenizers_file():
    for t in ("", " ", "Hello  World\n\n x", "Überfluß été ñ 漢字 🙂", "a" * 5000, "<|endoftext|> 12.5$ don't", "  \t"):
        assert encoder()(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def held(configs):
    c = Counter()
    for n, content in configs:
        for length, each in content:
            c[length] += n * each
    return c


def test_configurations_hold_the_histogram():
    rng = np.random.default_rng(0)
    for n, cap in ((1, 10), (50, 10), (5000, 64), (400, 2048)):
        h = Counter(rng.integers(1, cap + 1, n).tolist())
        for c in (configurations(h, cap), best_fit(h, cap)):
            assert held(c) == h and all(sum(x * k for x, k in content) <= cap for _, content in c)
        assert sum(k for k, _ in configurations(h, cap)) <= 1.01 * sum(k for k, _ in best_fit(h, cap)) + 1
    assert configurations({}, 10) == []
    assert sum(k for k, _ in configurations({6: 10, 4: 10}, 10)) == 10


def by_program(histogram, cap=2048):
    lengths = np.array(sorted(histogram))
    demand = np.array([histogram[int(x)] for x in lengths])
    x = fractional(lengths, demand.astype(float), cap)
    way = rounded(demand, x, 1.0)
    assert all(sum(int(lengths[i]) * k for i, k in c.items()) <= cap for _, c in way)
    return sum(n * sum(c.values()) for n, c in way)


def test_the_program_places_most_pieces_of_real_texts():
    h = Counter(len(ids_of(r[0])) % 2048 or 2048 for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    h = Counter({x: 20 * n for x, n in h.items() if x < 2048})
    assert by_program(h) > 0.8 * h.total()
    whole = sum(x * n for x, n in h.items())
    assert sum(n for n, _ in configurations(h)) <= 1.002 * -(-whole // 2048)


def test_few_lengths_that_best_fit_places_badly():
    for m in (1, 10, 1000):
        h = {1043: 6 * m, 551: 6 * m, 531: 6 * m, 471: 12 * m}
        assert sum(n for n, _ in best_fit(h, 2048)) > sum(n for n, _ in configurations(h)) == 9 * m


def test_small_cases_are_optimal_or_one_above():
    rng = np.random.default_rng(3)
    for _ in range(25):
        sizes = sorted(rng.integers(1, 13, 9).tolist(), reverse=True)
        got = sum(n for n, _ in configurations(Counter(sizes), 12))
        assert optimum(sizes, 12) <= got <= optimum(sizes, 12) + 1


def optimum(sizes, cap):
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= sizes[i]}.values():
            place(i + 1, [r - sizes[i] * (k == j) for k, r in enumerate(rooms)])
        place(i + 1, [*rooms, cap - sizes[i]])

    place(0, [])
    return best


def test_very_long_blanks_and_words():
    for t in ("a" + " " * 2_000_000 + "b", "\u00a0" * 1_000_000, "x" * 300_000):
        assert encoder()(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_price_equals_brute_force():
    lengths, value = np.array([2, 3, 5]), np.array([1.0, 2.0, 3.2])
    best = price(lengths, value, 12)
    for c in range(13):
        want = max(a * 1.0 + b * 2.0 + d * 3.2 for a in range(7) for b in range(5) for d in range(3) if 2 * a + 3 * b + 5 * d <= c)
        assert abs(best[c] - want) < 1e-9


def test_rows_round_trip(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["alpha", "Béta", "12", "x.y", "\n"], k=rng.randint(0, 120))) for _ in range(80)]
    texts += [None, "", texts[0], "word " * 300, " " * 100_000]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)] + [(5, texts[5], 1, 2)], "doc_id long, text string, length int, offset int")
    cap = 100
    got = best_fit_packing(df, cap).collect()
    ids = {i: ids_of(t) for i, t in enumerate(texts)}
    assert Counter((r.doc_id, r.piece) for r in got) == Counter((i, p) for i, x in [*ids.items(), (5, ids[5])] for p in range(-(-len(x) // cap)))
    by: dict = {}
    for r in got:
        x = ids[r.doc_id]
        assert r.start == (0 if r.piece == 0 else (len(x) - 1) % cap + 1 + (r.piece - 1) * cap) and r.length == min(cap, ((len(x) - 1) % cap + 1) if r.piece == 0 else cap)
        assert r.ids_crc32 == zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes())
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap
    total = sum(map(len, ids.values())) + len(ids[5])
    assert len(by) <= 1.05 * -(-total // cap) + 1
    assert best_fit_packing(df.limit(0)).count() == 0
