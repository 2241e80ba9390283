import random
import re
from collections import Counter

import corpus_pipeline
from formweave.llm.packing import encoder
from formweave.llm.pii import pseudonymiser, session_key

from .test_simhash import brute_groups, brute_print


def rows():
    rng = random.Random(8)
    vocab = {"en": ["the", "and", "Of", "with", "house"], "de": ["der", "und", "Straße", "mit", "Haus"]}
    out = []
    for i in range(80):
        lang = rng.choice(["en", "de"])
        text = " ".join(rng.choices(vocab[lang], k=rng.randint(30, 200)) + [f"v{rng.randrange(10**6)}" for _ in range(40)])
        out.append((i, text + (" 42.1.2.3 x" if i % 7 == 0 else ""), lang, f"s{i % 3}"))
    out += [(100 + i, t, x, "s1") for i, t, x, _ in out[:20]] + [(200 + i, t + " more", x, None) for i, t, x, _ in out[5:12]]
    return out + [(300, None, None, "s0"), (301, "", "en", "s0"), (302, "123 456 !!", "en", None)]


def test_clashing_and_extra_columns_come_through(spark, tmp_path):
    extra = ["score", "lang_pred", "n_pseudonyms", "kinds", "_rest", "_k", "_id", "_d", "spans", "_digest", "group", "pass_no"]
    more = [("u", "v"), ("w", None)]
    data = [(i, t, x, s, len(t or ""), *(f"{c}{i}" for c in extra), [(k, v) for k, v in more] if i % 2 else None) for i, t, x, s in rows()]
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in extra) + ", tags array<struct<k:string,v:string>>"
    df = spark.createDataFrame(data, schema)
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.dtypes == df.dtypes
        got = docs.drop("text", "n_chars").collect()
        assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in extra)
        assert all((r.tags is not None) == bool(r.doc_id % 2) for r in got)
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty_ = stage(spark, empty, str(tmp_path))
        assert empty_.count() == 0


def test_stages_and_their_decisions(spark, tmp_path):
    data = [(i, t, x, s, len(t or "")) for i, t, x, s in rows()]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, at = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = at[name] = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "packing" or docs.columns == df.columns
    text = {i: t for i, t, *_ in data}
    lingual = {i for i, t in text.items() if re.search(r"[^\W\d_]", t or "")}
    assert {r.doc_id for r in at["language ID"].collect()} == lingual
    groups = brute_groups({i: brute_print(text[i]) for i in sorted(lingual)})
    chosen = {i for i, c in groups.items() if i == c}
    assert Counter(r.doc_id for r in at["SimHash near-dedup"].collect()) == Counter(chosen)
    change = pseudonymiser(session_key(spark).encode())
    private = {r.doc_id: r for r in at["PII"].collect()}
    assert {i: r.text for i, r in private.items()} == {i: change(text[i])[0] for i in chosen}
    assert all(r.n_chars == len(r.text) for r in private.values())
    mixed = at["mixing"].collect()
    words = Counter(w for r in mixed for w in [(r.doc_id, x) for x in r.text.split()])
    most = Counter({(i, w): 2 * n for i, r in private.items() for w, n in Counter(r.text.split()).items()})
    assert words and all(n <= most[k] for k, n in words.items()) and all(r.n_chars == len(r.text) for r in mixed)
    total = sum(len(r.text.split()) for r in private.values())
    assert abs(sum(words.values()) - 1.5 * total) <= 4 * 128
    packed = at["packing"].collect()
    ids = Counter()
    for r in mixed:
        ids[r.doc_id] += len(encoder()(r.text)) + 1
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert got == ids
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(tuple, again.drop("sequence_id", "offset").collect())) == Counter(map(tuple, at["packing"].drop("sequence_id", "offset").collect()))
