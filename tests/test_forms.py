"""Whole forms end to end, and the small operators around them."""

import json

import pytest
from pyspark.sql import functions as F

from formweave.functions import registered
from formweave.functions.similarity import differences, ratio, window_ratios, with_ratios
from formweave.operators import forms, matching, records, verdict
from formweave.sources import snapshots
from formweave.streaming.carry import normal_carry


def parts(spark, rows):
    return spark.createDataFrame(rows, "folder int, pos long, col double, image string, text string")


def test_validate_joins_parts_and_judges_all_fields(spark):
    known = spark.createDataFrame(
        [(1, "L_I@60001", "Ann Lee", "OR", "500$", "10$", None), (2, "L_I@60002", "Bob Ray", "", "70$", "5$", "65$")],
        "pos int, record_no string, ph_name string, ph_state string, premium string, discount string, total_amount string",
    )
    got = parts(spark, [
        (1, 1, 0.2, "a", "L_I@60001\nL_I@60001\nAnn Lee"), (1, 2, 0.8, "a", "L_I@60002 60002\nB0b Ray 70$ 6$ TR12AN34SA56CT"),
        (1, 3, 0.3, "b", "OR 500$ 10$ TR12AN34SA56CT"), (1, 4, 0.5, "c", "L_I@77777 77777 nobody TR12AN34SA56CT"), (1, 5, 0.5, "c", None),
    ])
    found, results = forms.validate(got, known)
    rows = {r.form_id: r for r in found.collect()}
    one, two = rows["1:1"], rows["1:2"]
    assert (one.image, one.parts, one.record_no, one.verdict, one.mismatched, one.image_mismatch) == ("b", 2, "L_I@60001", "PASS", 0, False)
    assert (two.image, two.verdict, two.mismatched) == ("a", "FAIL", 2)
    assert (rows["1:4"].matched, rows["1:4"].verdict) == (False, None) and rows["1:5"].matched is False
    of = {(r.form_id, r.field): r for r in results.collect()}
    assert of["1:2", "ph_name"].status == "match" and of["1:2", "ph_name"].found == "Bob Ray"
    assert of["1:2", "discount"].found == "6$" and of["1:2", "discount"].status == "mismatch"
    assert (of["1:2", "total_amount"].expected, of["1:2", "total_amount"].found, of["1:2", "total_amount"].status) == ("65$", "64$", "mismatch")
    assert of["1:1", "total_amount"].found == "490$" and of["1:2", "ph_state"].status == "match" and of["1:1", "form_no"].status == "not_on_form"
    assert forms.validate(got.limit(0), known)[0].count() == 0


def test_validate_takes_the_whole_number(spark):
    """60016 stands as often as 160016 does where the latter is printed, and comes earlier in the store."""
    known = spark.createDataFrame([(1, "L_I@60016", "Bob Ray"), (2, "L_I@160016", "Ann Lee")], "pos int, record_no string, ph_name string")
    got = parts(spark, [(1, 1, 0.2, "a", "L_I@160016\nL_I@160016\nAnn Lee TR12AN34SA56CT"), (1, 2, 0.2, "b", "L_I@60016\nL_I@60016\nBob Ray TR12AN34SA56CT")])
    found, _ = forms.validate(got, known)
    assert {(r.form_id, r.record_no) for r in found.collect()} == {("1:1", "L_I@160016"), ("1:2", "L_I@60016")}


def test_cells_are_stitched_and_fall_back_to_words(spark):
    df = spark.createDataFrame([(1, 1, ["L_I@60001", "Ann Lee"]), (1, 2, ["Oak St", "C-123456"]), (1, 3, ["lost  end"]), (1, 4, [""])], "folder int, pos int, cells array<string>")
    got = sorted((r.pos, r.cells, r.state) for r in forms.stitch_cells(df).collect())
    assert got == [(2, ["L_I@60001", "Ann Lee", "Oak St", "C-123456"], "joined"), (3, ["lost  end"], "orphan")]
    row = spark.range(1).select(
        forms.as_cells(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(1)), F.array(F.lit("a b"))).alias("x"), forms.as_cells(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(1), F.lit(2)), F.array(F.lit("a b"))).alias("y")
    ).first()
    assert row.x == ["a", "b"] and row.y == ["a b"]


def test_uploads_are_gated(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"record_no": "1"}, {"record_no": "2", "x": None}]))
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "bad.json").write_text("{not json")
    snapshots.ingest(spark, str(tmp_path / "a.json"), str(tmp_path), "20240101_000000")
    assert sorted(r.raw["record_no"] for r in snapshots.read_snapshot(spark, str(tmp_path)).collect()) == ["1", "2"]
    for name in ("none.json", "bad.json", "a.csv"):
        with pytest.raises(ValueError):
            snapshots.ingest(spark, str(tmp_path / name), str(tmp_path), "20240102_000000")


def test_recompute_leaves_missed_fields_out(spark):
    df = spark.createDataFrame([(1, "match"), (1, "ocr_missed"), (2, "mismatch"), (2, "match"), (2, "match"), (3, "ocr_missed")], "form_id int, status string")
    got = {r.form_id: (r.checked, r.overall_score, r.verdict) for r in verdict.recomputed(df).collect()}
    assert got == {1: (1, 100.0, "PASS"), 2: (3, 66.7, "FAIL"), 3: (0, 0.0, "PASS")}
    mapped = spark.createDataFrame([(1, True), (2, False), (3, None)], "form_id int, matched boolean")
    assert [r.form_id for r in records.by_mapping(mapped, False).orderBy("form_id").collect()] == [2, 3]


def test_functions_known_to_sql(spark):
    registered.register(spark)
    row = spark.sql("SELECT strip_accents('Été') AS a, compare_key(' L-I@60001 é') AS k, indel_ratio('KITTEN', 'SITTING') AS r, char_diff('ab', 'ax') AS d, align_form(array('ANN LEE', 'OR'), array('X', 'ANN', 'LEE', 'OR')) AS s").first()
    assert row.a == "Ete" and row.k == "I@60001E" and row.r == ratio("KITTEN", "SITTING")
    assert [x.asDict() for x in row.d] == differences("ab", "ax") and [(x.begin, x.end) for x in row.s] == [(1, 3), (3, 4)]


def test_windows_of_no_words_and_long_values():
    assert [t.shape for t in window_ratios([(["x"], [])], [[3]])[0]] == [(4, 1)]
    long = "word " * 30
    table = window_ratios([([long.strip()], long.split())], [[34]])[0][0]
    assert table[30, 30] == 100.0 and table[1, 1] == ratio(long.strip(), "word")


def test_carry_is_made_normal():
    assert normal_carry(["a", ["b", 0.2], ["c"]]) == [(-3, "a", 0.5), (-2, "b", 0.2), (-1, "c", 0.5)]


def test_validated_forms_are_aligned_once(spark, monkeypatch):
    """Field rows and forms come from one judging of each form, and the summary of a form is that of its field rows."""
    known = spark.createDataFrame([(i, f"L_I@{60000 + i}", "Ann Lee", "OR", "500$", "" if i % 2 else "10$", "note") for i in range(20)], "pos int, record_no string, ph_name string, ph_state string, premium string, discount string, remark string")
    got = parts(spark, [(1, i, 0.2, "a", f"L_I@{60000 + i}\nL_I@{60000 + i}\n{'Ann Lee' if i % 3 else 'Bob Rex'} {'OR' if i % 4 else ''} 5{i % 2}0$ 10$ TR12AN34SA56CT") for i in range(20)])
    aligned, align = spark.sparkContext.accumulator(0), forms.align_forms

    def counted(*args):
        def run(batches):
            for b in batches:
                aligned.add(b.num_rows)
                yield b

        out = align(*args)
        return out.mapInArrow(run, out.schema)

    monkeypatch.setattr(forms, "align_forms", counted)
    found, results = forms.validate(got, known)
    rows = {r.form_id: r for r in found.collect()}
    each = results.collect()
    assert aligned.value == 20 == len(rows) and len(each) == 20 * len(forms.KEYS)
    for s in verdict.form_summary(results).collect():
        r = rows[s.form_id]
        assert (r.checked, r.matched_fields, r.mismatched, r.overall_score, r.verdict) == (s.checked, s.matched, s.mismatched, s.overall_score, s.verdict)
    assert len({r.overall_score for r in rows.values()}) > 2
    assert {(r.expected, r.found, r.status, r.score, r.on_form) for r in each if r.field == "remark"} == {("note", "", "not_on_form", None, False)}
    assert {(r.expected, r.found, r.status, r.score) for r in each if r.field == "agent_city"} == {(None, "", "match", 100.0)}


def test_numbers_are_counted_before_they_meet_records(spark):
    """Only runs of digits that stand twice, without overlaps, go to the join; what is found stays the same."""
    heads = {1: "11111 1111", 2: "11111 11111", 3: "60016 060016", 4: "160016\n160016\n99999 99999", 5: "6001 60016 001", 6: None, 7: "12312312312"}
    numbers = ["11111", "60016", "160016", "99999", "123", "231", "1111"]
    texts, store = spark.createDataFrame(list(heads.items()), "id int, text string"), spark.createDataFrame(list(enumerate(f"L_I@{n}" for n in numbers)), "pos int, record_no string")
    for whole in (False, True):
        want = {}
        for i, h in heads.items():
            d = "".join(c for line in (h or "").split("\n")[:2] for c in line if c.isdigit())
            best = max(((d.count(n), len(n) if whole else 0, -p, n) for p, n in enumerate(numbers) if d.count(n) >= 2), default=None)
            want[i] = (f"L_I@{best[3]}", best[0]) if best else (None, None)
        assert {r.id: (r.record_no, r.n) for r in matching.match_by_number(texts, store, whole=whole).collect()} == want
    plan = matching.best_numbers(texts, store)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("locate(") > plan.index("Join Inner") and "length(h" not in plan[: plan.index("Join Inner")]


def test_ratios_of_lists(spark):
    rows = [(1, ["ab", "same", None], ["ax", "same", "y"]), (2, [], []), (3, None, None), (4, ["", "abc"], ["", ""])]
    got = with_ratios(spark.createDataFrame(rows, "i int, a array<string>, b array<string>").coalesce(1), "a", "b", "r")
    assert {r.i: r.r for r in got.collect() if r.a} == {1: [ratio("ab", "ax"), 100.0, None], 4: [100.0, 0.0]}
