import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from formweave.llm.windows import Windows, order_preserving_packing, places_to_cut, plain_encoder, sentence_ends

tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
tokenizer.encode_special_tokens = True


def ids_of(t):
    return [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]


def padding(n, cap=2048):
    return 0 if n & (n - 1) == 0 else cap - n


def least_cost(places, cost, cap):
    """Least cost up to each place, from all windows."""
    best = {0: 0}
    for p, c in zip(places, cost):
        best[p] = c + min(best[q] + padding(p - q, cap) for q in best if 0 < p - q <= cap)
    return best[places[-1]]


def cost_of(ends, places, cost, cap):
    of = dict(zip(places, cost))
    return sum(of[e] + padding(e - b, cap) for b, e in zip([0, *ends], ends))


@pytest.mark.parametrize("cap", (4, 64, 2048))
def test_windows_cost_least_however_the_stream_is_cut(cap):
    rng = np.random.default_rng(cap)
    for _ in range(15):
        places = np.cumsum(rng.integers(1, max(2, cap // rng.integers(2, 9)), 300))
        cost = rng.choice([0, 16, 128], 300)
        w, ends = Windows(cap), []
        for part in np.array_split(np.arange(300), rng.integers(1, 40)):
            w.feed(places[part], cost[part])
            ends += w.settled()
        assert len(w.pos) < 300 or len(ends) == 0
        ends += w.settled(end=True)
        assert ends[-1] == places[-1]
        assert cost_of(ends, places.tolist(), cost.tolist(), cap) == least_cost(places.tolist(), cost.tolist(), cap)


def test_sentence_ends():
    t = 'One. Two! "Three?" v1.5 is (four.) End.\nNext。五！Six.'.encode()
    ends = sentence_ends(t)
    cut = [bytes(x).decode() for x in np.split(np.frombuffer(t, np.uint8), ends)]
    assert cut == ["One.", " Two!", ' "Three?"', " v1.5 is (four.)", " End.", "\n", "Next。", "五！", "Six.", ""]
    assert len(sentence_ends(b"")) == 0 and len(sentence_ends(b'"')) == 0


def slow_ends(data):
    """Byte by byte."""
    out = set()
    for i, c in enumerate(data):
        j = i
        while j >= 0 and data[j] in b"\"')]":
            j -= 1
        stop = j >= 0 and data[j] in b".!?" and (i + 1 == len(data) or data[i + 1] in b" \t\n\x0b\x0c\r")
        if stop or c == 10 or any(data[: i + 1].endswith(m.encode()) for m in "。！？"):
            out.add(i + 1)
    return sorted(out)


def test_sentence_ends_byte_by_byte():
    rng = random.Random(3)
    for _ in range(300):
        data = "".join(rng.choice(["a", ".", "!", '"', ")", "]", " ", "\n", "。", "！", "é"]) for _ in range(rng.randint(0, 40))).encode()
        assert sentence_ends(data).tolist() == slow_ends(data)


def test_ids_equal_those_of_the_tokenizers_file():
    for t in ("", "Hello  World\n\n x", "Überfluß été ñ 漢字 🙂", "a" * 5000, "<|endoftext|> 12.5$ don't", " " * 7000, "x" + "\u3000" * 2500 + "y", " x" * 3000):
        assert plain_encoder()(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_places_are_ends_of_documents_sentences_words_or_ids():
    texts = ["One two. Three four.", "", "", "x " * 400, "y" * 900, "short"]
    ids = [np.array(ids_of(t)[:-1], np.uint32) for t in texts]
    places, cost = places_to_cut(ids, "".join(texts).encode())
    closes = np.cumsum([len(i) + 1 for i in ids])
    assert set(closes) == set(places[cost == 0]) and not set(closes - 1) & set(places) - set(closes)
    assert places[cost == 8].tolist() == [3]
    assert max(np.diff(places, prepend=0)) <= 130 and (np.diff(places) > 0).all()
    assert len(places_to_cut([], b"")[0]) == 0


def checked(rows, docs, cap):
    """All conditions of the rows; gives the padding."""
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
    want = {}
    for doc, text in docs:
        want.setdefault(doc, []).append(ids_of(text))
    for doc, lists in want.items():
        got = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by[doc])
        assert sum(x[1] for x in got) == sum(map(len, lists))
        if len(lists) == 1:
            at = 0
            for start, length, crc, n in got:
                assert start == at and length > 0 and n == len(lists[0])
                assert crc == zlib.crc32(np.array(lists[0][start : start + length], "<u4").tobytes())
                at += length
    for rs in seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= cap
    return sum(padding(sum(r.length for r in rs), cap) for rs in seq.values())


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma.", "delta!", "Ünï", "e\n", "12.5"]) for _ in range(n))


def test_pieces_are_whole_ordered_and_cost_least(spark):
    rng = random.Random(1)
    docs = [(i, prose(rng, rng.randint(0, 700))) for i in range(60)] + [(100, None), (101, ""), (102, prose(rng, 30_000)), (103, "z" * 9000), (104, " " * 5000), (105, "<|endoftext|>")]
    for cap in (64, 2048):
        df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
        rows = order_preserving_packing(df, capacity=cap, chunk=3000).collect()
        got = checked(rows, docs, cap)
        ids = [np.array(ids_of(t)[:-1], np.uint32) for _, t in docs]
        places, cost = places_to_cut(ids, "".join(t or "" for _, t in docs).encode(), min(128, cap // 2 - 1))
        ends = np.cumsum([n for _, n in sorted((s, sum(r.length for r in rows if r.sequence_id == s)) for s in {r.sequence_id for r in rows})]).tolist()
        if cap == 64:  # all windows are tried
            assert cost_of(ends, places.tolist(), cost.tolist(), cap) == least_cost(places.tolist(), cost.tolist(), cap)
        else:
            assert got <= 0.005 * sum(len(i) for i in ids)
        order = [r.doc_id for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
        assert list(dict.fromkeys(order)) == [d for d, _ in docs]


def test_order_repeats_nulls_and_other_columns(spark):
    docs = [(5, "e e.", 1, 1), (3, "c c.", 1, 2), (3, "c c.", 1, 2), (None, "n", 1, 3), (9, None, 1, 4)]
    df = spark.createDataFrame(docs, "doc_id long, text string, length long, offset int").coalesce(1)
    rows = order_preserving_packing(df, order=["doc_id"]).collect()
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))] == [None, 3, 3, 5, 9]
    assert checked([r for r in rows if r.doc_id not in (3, None)], [], 2048) is not None
    assert sum(r.length for r in rows) == sum(len(ids_of(d[1])) for d in docs)
    assert order_preserving_packing(df.where("false")).collect() == []
