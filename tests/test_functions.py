import re
import unicodedata

from formweave.functions import canon, text
from formweave.functions.similarity import ratio
from formweave.operators import anchors, matching, verdict
from pyspark.sql import functions as F

VALUES = ["", " ", "L_I@61637", "L I@61637", "I@61637", "P-892915425498290", "P 892915425498290", "892915425498290", "Wellington,", "wellington", "Fl", "FL", "O+", "0+", "À bientôt", "A BIENTOT", "IA", "LA", "Queen]", "Geen J", "P1234", "a b", "ﬁ", "ǖ", "Straße", "é", None]


def plain_key(v):
    v = "".join(c for c in unicodedata.normalize("NFD", v) if unicodedata.category(c) != "Mn")
    k = re.sub(r"[\s\-,_]+", "", v).upper()
    k = re.sub(r"^[A-Z](?=[0-9]{5,}$)", "", re.sub("^L(?=I@)", "", k))
    return k.translate(str.maketrans("L|O]Q", "II0JG"))


def test_keys(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "v string")
    for r in df.select("v", text.compare_key(F.col("v")).alias("k"), text.collapse(F.col("v")).alias("c"), text.natural_key(F.col("v")).alias("n")).collect():
        assert r.k == (None if r.v is None else plain_key(r.v)), r.v
    names = spark.createDataFrame([("b10",), ("B9",), ("ä2",), ("a10",), ("a01",)], "v string")
    assert [r.v for r in names.orderBy(text.natural_key(F.col("v"))).collect()] == ["a01", "ä2", "a10", "B9", "b10"]


def test_amounts_and_ids(spark):
    rows = [("1,000.50$", "10"), ("5$", "10$"), ("x", "1"), (None, "1"), ("9" * 25, "1")]
    got = spark.createDataFrame(rows, "p string, d string").select(text.total_amount(F.col("p"), F.col("d")).alias("t"), text.record_id(F.lit("x@ 12345678")).alias("i"), text.record_id(F.lit("@12")).alias("none")).collect()
    assert [r.t for r in got] == ["100040$", "-5$", "", "", ""] and got[0].i == "123456" and got[0].none is None


def test_similarity_expression_equals_kernel(spark):
    pairs = [("KITTEN", "SITTING"), ("", ""), ("", "A"), ("ABC", "ABC"), ("ABCDEF", "FEDCBA")]
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.indel_ratio(F.col("a"), F.col("b")).alias("r")).collect():
        assert abs(r.r - ratio(r.a, r.b)) < 1e-9


def test_canonical_values(spark):
    cases = {
        "card_type": {"visa": "Visa", "Amerlcan Express": "American Express", "zzz": "zzz", "?": "?"}, "blood_group": {"o+": "O+", "AB": "AB+"}, "payment_option": {"Cash-Credit Card": "Cash/Credit Card"},
        "premium": {" 1004 ": "100$", "12$": "12$", "abc4": "abc4", "4": "4", "": "", "1?4": "1?4"}, "period_of_insurance": {"for 3 yaers": "3 Year", "none": "none"},
        "invoice_no": {"l_I@61234 L-Max": "L-Max", "@123 x": "@123 x"}, "ph_state": {"<NY": "NY", "New York": "New York"}, "policy_no": {"p 123456": "P-123456", "12345": "12345"}, "ph_name": {" Ann ": "Ann"},
    }
    for key, of in cases.items():
        df = spark.createDataFrame([(v,) for v in of], "v string")
        assert {r.v: r.c for r in df.select("v", canon.canonical(key, F.col("v")).alias("c")).collect()} == of, key


def test_addresses(spark):
    cases = {
        "Ann Lee 12 Oak St. Salem": ("Ann Lee", "12 Oak St.", "Salem"), "Ann Lee P.O. Box 77 Reno": ("Ann Lee", "P.O. Box 77", "Reno"), "Ann Lee N.A. Reno": ("Ann Lee", "N.A.", "Reno"),
        "Ann Lee 9 Elm Suite 4 Dover": ("Ann Lee", "9 Elm Suite 4", "Dover"), "Columbia x Columbia": ("", "Columbia x", "Columbia"), "Ann Lee 55 Mill Silver Springs": ("Ann Lee", "55 Mill", "Silver Springs"),
        "Ann Lee 12 Oak St. Apt 5 Reno": ("Ann Lee", "12 Oak St. Apt 5", "Reno"), "Ann Lee 12 Oak St NW Second Floor Reno": ("Ann Lee", "12 Oak St NW Second Floor", "Reno"), "Ann Lee 45 Mill Los Angeles": ("Ann Lee", "45 Mill", "Los Angeles"),
        "Ann New York New York": ("Ann", "New York", "New York"), "Columbia Columbia": ("", "Columbia", "Columbia"), "Ann 9 Boston st, Salem": ("Ann", "9 Boston st", "Salem"), "Ann 7 Broadway Ave. Dover": ("Ann", "7 Broadway Ave", "Dover"),
        "Ann Lee West Oak Road Salem": ("Ann Lee", "West Oak Road", "Salem"), "Ann Lee Five Elm Lane Salem": ("Ann Lee", "Five Elm Lane", "Salem"), "Ann Lee Five Elm Lane #12 Salem": ("Ann Lee Five Elm Lane", "#12", "Salem"), "Oak Road": ("", "Oak Road", ""), "Road": ("", "Road", ""), "Ann 12 Oak Rd South Bend": ("Ann", "12 Oak Rd", "South Bend"),
        "Ann 12 Oak Rd South Reno": ("Ann", "12 Oak Rd South", "Reno"), "Ann 5 Hill Rd 77 3rd fl Rm 2 Mesa": ("Ann", "5 Hill Rd 77 3rd fl Rm 2", "Mesa"), "Ann 8 Ridge Salt Lake City": ("Ann", "8 Ridge", "Salt Lake City"), "Ann 3 Park Box 9, Reno": ("Ann", "3 Park Box 9", ", Reno"),
        "Ann Lee Unit 4 . Reno": ("Ann Lee", "Unit 4", "Reno"), "Ann not applicable": ("Ann", "not applicable", ""), "Ann Lee 12": ("Ann Lee", "", "12"), "6 Avenue of the Americas New York": ("", "6 Avenue of the Americas", "New York"),
        "Ann Lee Oak Reno": ("Ann Lee", "Oak", "Reno"), "Ann Lee": ("Ann", "Lee", ""), "Ann": ("Ann", "", ""), "": ("", "", ""),
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "b string")
    assert {r.b: tuple(r.split) for r in anchors.split_address(df, "b").collect()} == cases | {None: ("", "", "")}
    r = anchors.split_holder(spark.createDataFrame([("Ann Lee 12 Oak St. Salem OR 97301 (503) 555-0100",)], "b string"), "b").first()
    assert (r["name"], r.address, r.city, r.state, r.zip, r.phone) == ("Ann Lee", "12 Oak St.", "Salem", "OR", "97301", "(503) 555-0100")


def test_statuses_and_summaries(spark):
    rows = [(1, "a", True, "x", "X"), (1, "b", True, "", "junk"), (1, "c", True, "y", " "), (1, "d", False, "z", ""), (1, "e", True, "abc", "abd"), (2, "a", True, None, None)]
    df = spark.createDataFrame(rows, "form_id long, field string, on_form boolean, expected string, found string")
    out = {(r.form_id, r.field): (r.status, r.score, r.found) for r in verdict.field_results(df).collect()}
    assert out == {(1, "a"): ("match", 100.0, "x"), (1, "b"): ("match", 100.0, ""), (1, "c"): ("ocr_missed", 0.0, ""), (1, "d"): ("not_on_form", None, ""), (1, "e"): ("mismatch", 66.7, "abd"), (2, "a"): ("match", 100.0, "")}
    s = {r.form_id: r for r in verdict.form_summary(verdict.field_results(df)).collect()}
    assert (s[1].checked, s[1].matched, s[1].mismatched, s[1].overall_score, s[1].verdict) == (4, 2, 2, 50.0, "FAIL") and s[2].verdict == "PASS"
    notes = spark.createDataFrame([(1, "e", "ok"), (1, "a", "ok"), (1, "e", "ok")], "form_id long, field string, note string")
    r = {x.form_id: x for x in verdict.review_summary(verdict.reviewed(verdict.field_results(df), notes)).collect()}[1]
    assert (r.checked, r.false_positives, r.missed, r.verdict_review, r.verdict_api, r.review_score) == (3, 1, 1, "PASS", "FAIL", 100.0)
    filled = {x.field: x.status for x in verdict.filled(verdict.field_results(df).where("form_id = 1")).collect()}
    assert filled["c"] == "ocr_missed" and filled["e"] == "mismatch"


def test_matching_ties_and_near_values(spark):
    records = spark.createDataFrame([(0, "L_I@11111"), (1, "L_I@12345"), (2, "X-12345"), (3, None)], "pos long, record_no string")
    texts = [(1, "\n L_I@12345 12345\n11111"), (2, "1111111111\n12345 1"), (3, "12345\n\n"), (4, None), (5, "1234512345 11111\n11111")]
    got = {r.id: (r.record_no, r.n) for r in matching.match_by_number(spark.createDataFrame(texts, "id long, text string"), records).collect()}
    assert got == {1: ("L_I@12345", 2), 2: ("L_I@11111", 2), 3: (None, None), 4: (None, None), 5: ("L_I@11111", 2)}
    known = spark.createDataFrame([("k", "VISA"), ("k", "DISCOVER")], "key string, value string")
    words = spark.createDataFrame([("k", "visa"), ("k", "VISE"), ("k", "DISCOVERABLE1"), ("other", "VISA")], "key string, word string")
    for short in (True, False):
        assert {(r.key, r.word): r.score for r in matching.nearest_values(words, known, short).collect()} == {("k", "visa"): 100.0, ("k", "VISE"): 75.0, ("k", "DISCOVERABLE1"): 0.0, ("other", "VISA"): 0.0}


def test_choices_are_compared_once_for_each_value(spark):
    """No matrix of letters in expressions, which took minutes over a few thousand values; odd values as before."""
    df = spark.createDataFrame([(v,) for v in (None, "", "o?", "ßx", "Vosa", "PLAN-g", "Vosa")], "v string").coalesce(1)
    out = df.select(canon.canonical("card_type", F.col("v")).alias("card"), canon.canonical("plan_name", F.col("v")).alias("plan"))
    assert "aggregate(" not in out._jdf.queryExecution().toString()
    assert [tuple(r) for r in out.collect()] == [(None, None), ("", ""), ("o?", "o?"), ("ßx", "ßx"), ("Vosa", "Vosa"), ("PLAN-g", "PLAN G"), ("Vosa", "Vosa")]
