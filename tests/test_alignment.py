import itertools
import random

from formweave.catalog import KEYS, field_catalog
from formweave.functions.scoring import field_score, score, score_words
from formweave.functions.similarity import common_length, differences, ratio
from formweave.functions.text import tokens
from formweave.operators import alignment
from formweave.operators.alignment import LOCATED, align, align_forms, best_chain, segment, segment_forms
from pyspark.sql import functions as F

NONE = float("-inf")


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_similarity_equals_the_plain_matrix():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcde ", k=rng.randint(0, 12))) for _ in range(2))
        assert common_length(a, b) == plain_lcs(a, b)
    assert ratio("", "") == 100 and ratio("a", "") == 0 and ratio("KITTEN", "SITTING") == 100 * 8 / 13


def test_differences_mark_only_what_differs():
    d = differences("C-1234", "C 12x4")
    assert "".join(x["text"] for x in d) == "C 12x4" and [x["text"] for x in d if x["diff"]] == ["x"]
    assert [x["diff"] for x in differences("ILO|", "1|0l")] == [True, False] and differences("x", "") == []


def brute_skip(values, m):
    """Best total over all ordered runs; ties: the last field's first end, then its shortest run, and so on back."""
    best = None
    for cuts in itertools.combinations_with_replacement(range(m + 1), 2 * len(values)):
        runs = list(zip(cuts[::2], cuts[1::2]))
        if all(e - b < len(t) for (b, e), t in zip(runs, values)):
            total = sum(t[e - b][e] for (b, e), t in zip(runs, values))
            if best is None or total > best:
                best = total
    return best


def test_chain_is_optimal():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(60):
        m, n = int(rng.integers(0, 6)), int(rng.integers(1, 4))
        tables = []
        for _ in range(n):
            t = np.full((4, m + 1), NONE)
            for k in range(min(4, m + 1)):
                t[k, k:] = rng.integers(0, 5, m + 1 - k) if k else 0
            tables.append(t)
        runs = best_chain(tables, skip=True)
        assert all(b <= e for b, e in runs) and all(x[1] <= y[0] for x, y in zip(runs, runs[1:]))
        assert sum(t[e - b, e] for (b, e), t in zip(runs, tables)) == brute_skip([t.tolist() for t in tables], m)


def test_align_ties_skips_and_recovery():
    assert align([], ["A"]) == [] and align(["A"], []) == [(0, 0)]
    assert align(["ANN LEE", "RENO"], ["X", "ANN", "LEE", "Y", "RENO"]) == [(1, 3), (4, 5)]
    assert align(["A", "A"], ["A", "A"]) == [(0, 1), (1, 2)]
    assert align(["YES"], ["NO", "YEZ"]) == [(1, 2)]
    assert align(["ABC", "YES", "XYZ"], ["ABC", "YE5", "XYZ"]) == [(0, 1), (1, 2), (2, 3)]
    assert align(["A"], ["A", "A", "A"]) == [(0, 1)]


def test_round_trip_without_noise(spark):
    keys = ["record_no", "ph_name", "ph_city", "premium"]
    rows = [(i, [f"L_I@{60000 + i}", f"Ánn Lee{i}", None if i == 1 else "Salt Lake City", f"{i}00$"]) for i in range(1, 4)]
    rows = [(i, v, "noise " + " ".join(x for x in v if x) + " tail") for i, v in rows] + [(9, [None] * 4, None), (10, ["a", "b", "c", "d"], "")]
    df = spark.createDataFrame(rows, "form_id long, v array<string>, text string")
    for r in align_forms(df, F.col("v"), F.col("text"), keys).collect():
        assert [(s.field, s.found) for s in r.spans] == [(k, "" if r.form_id == 10 else x) for k, x in zip(keys, r.v) if x]


def test_kernel_and_expression_scores_agree(spark):
    samples = ["", "97301", "97301 -1234", "(555) 123 4567", "1/2/2024", "a@mail.x", "N.A.", "500$", "5004", "AB +", "O", "P- 1234567", "123456789012345", "AB12CD34EF56GH", "L_I@61234", "MAX@LIFEINS", "ab12x", "PLAN B", "3 Year", "yes.", "Credit Card", "12 Oak St.", "P.O. Box 7", "St Paul", "Salt Lake City", "NE", "<NY", "90", "150", "C-1234567", "a b c d"]
    from formweave.functions.scoring import RULES

    kinds = ["name", "city", "address", *RULES]
    df = spark.createDataFrame([(s,) for s in samples], "s string").withColumn("w", tokens(F.col("s")))
    got = df.select("s", *(score(k, F.col("w")).cast("double").alias(k) for k in kinds)).collect()
    for r in got:
        for k in kinds:
            assert abs(r[k] - score_words(k, tuple(r.s.split()))) < 1e-9, (r.s, k)
    assert score_words("state", ("Ohio",), frozenset({"OHIO"})) == 100 and score_words("card_type", ("Vise",), frozenset({"VISA"})) == 75
    assert field_score("name", 1, 4, 2, ()) == 40 - 9 - 3


FORM = "L_I@60001 L-Max@LifeIns_21-1001 1/2/2020 AB12X 12AB34CD Ann Lee 12 Oak St. Salem OR 97301 (503) 555-0100 a.lee@mail.test 3/4/1970 N.A. Bob Lee 7 Elm Rd. Salem OR 97302 N.A. 90 170 150 O+ P-892915425498 AB34CD56EF78GH Acme Company 5 Main St. Reno NV 89501 ZX12CV34BN56MM QW12ER34TY56UU PLAN B PB1234 500$ 3 Year No No No No No No No No No Yes Credit Card 100$ 10$ Visa C-8698231518 N.A. Ann Lee TR12AN34SA56CT"


def test_segment_covers_all_words_or_says_that_it_cannot(spark):
    runs, fits = segment(FORM.split())
    assert fits and runs[0] == (0, 1) and runs[-1][1] == len(FORM.split())
    long = " ".join(["word"] * 300)
    df = spark.createDataFrame([(1, FORM), (2, long), (3, ""), (4, None)], "form_id long, t string")
    got = {r.form_id: r for r in segment_forms(df, "t").collect()}
    assert got[1].values["policy_no"] == "P-892915425498" and got[1].values["ph_zip"] == "97301" and not got[1].overflow
    assert got[2].overflow and not any(got[2].values.values())
    assert not got[3].overflow and not any(got[4].values.values())
    cells = [["L_I@60001"], ["L-Max@LifeIns_21-1001"], ["1/2/2020"], *[[w] for w in FORM.split()[3:]]]
    assert segment([], cells=cells)[0] == runs
    rows = [(1, [w[0] for w in cells]), (2, [" ", *(w[0] for w in cells), None]), (3, None), (4, ["x"] * 500)]
    of = {r.form_id: r for r in segment_forms(spark.createDataFrame(rows, "form_id int, t array<string>"), "t", cells=True).collect()}
    assert of[1]["values"] == got[1]["values"] == of[2]["values"] and not of[1].overflow
    assert of[4].overflow and not any(of[4]["values"].values()) and not any(of[3]["values"].values())


def test_catalog(spark):
    rows = field_catalog(spark).orderBy("pos").collect()
    assert [r.key for r in rows] == KEYS and sum(r.on_form for r in rows) == 55 and sum(r.most + 1 for r in rows if r.most) == 166
    assert len(LOCATED) == 55 and next(r.alias for r in rows if r.key == "ph_zip") == "policy_holder_zip"


def test_forms_of_one_file_are_dealt_to_all_tasks(spark):
    one = spark.createDataFrame([(1, "L_I@60001")], "form_id int, text string").coalesce(1)
    plan = segment_forms(one, "text")._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {spark.conf.get('spark.sql.shuffle.partitions')}, true" in plan


def test_many_chains_at_once_equal_one_by_one(monkeypatch):
    """Forms of all sizes are put in common tables, and none goes through best_chain() alone."""
    rng = random.Random(3)
    vocab = ["ann", "lee", "12", "oak", "st.", "\u00c9t\u00e9", "salem", "P-8929", "\U0001f642b"]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    forms = [([" ".join(some(rng.choice([1, 1, 2, 25]))) for _ in range(rng.randrange(5))], some(rng.choice([0, 1, 3, 9, 40]))) for _ in range(150)]
    want = [alignment.align_all([f])[0] for f in forms]
    monkeypatch.setattr(alignment, "best_chain", None)
    assert alignment.align_all(forms) == want
    monkeypatch.setattr(alignment, "CELLS", 300)
    assert alignment.align_all(forms) == want


def test_forms_of_one_file_are_aligned_by_all_tasks(spark):
    df = spark.createDataFrame([(i, "ann lee") for i in range(64)], "form_id long, text string").coalesce(1)
    out = align_forms(df, F.array(F.lit("lee")), F.col("text"), ["ph_name"])
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
