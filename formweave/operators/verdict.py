"""Field statuses, form verdicts and what reviewers change about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formweave.catalog import ON_FORM
from formweave.functions.similarity import with_ratio
from formweave.functions.text import collapse, compare_key, digits, total_amount

#: The fields that a form is judged by: what is printed on it, and the total.
PRINTED = [*ON_FORM, "total_amount"]


def field_status(expected: Column, found: Column, on_form: Column) -> Column:
    """match, mismatch, ocr_missed or not_on_form for one field; a blank expected value matches."""
    return F.when(~on_form, "not_on_form").when(blank(expected), "match").when(blank(found), "ocr_missed").when(alike(expected, found), "match").otherwise("mismatch")


def blank(c: Column) -> Column:
    """Nothing is left of a value without white space and marks. A plain sign tells the most at once."""
    return F.coalesce(~c.rlike("[!-~]"), F.lit(True)) & (F.coalesce(collapse(c), F.lit("")) == "")


def alike(expected: Column, found: Column) -> Column:
    """Both have one key, as equal values do."""
    return (expected == found) | (compare_key(expected) == compare_key(found))


def field_score(status: Column, ratio: Column) -> Column:
    """Similarity of both keys to one place, half to even; 100 for matches and 0 for missed values, none if not on forms."""
    return F.when(status == "not_on_form", None).when(status == "match", 100.0).when(status == "ocr_missed", 0.0).otherwise(F.bround(ratio, 1))


def shown(status: Column, expected: Column, found: Column) -> Column:
    """found as it is shown: the record's value for matches, nothing for missed and blank ones."""
    return F.when(status == "mismatch", found).when((status == "match") & ~blank(expected), expected).otherwise("")


def field_results(fields: DataFrame) -> DataFrame:
    """fields (form, field, on_form, expected, found) with status, score, and found as shown (matches show the record's)."""
    rows = fields.withColumn("status", field_status(F.col("expected"), F.col("found"), F.col("on_form")))
    rows = with_ratio(rows.withColumns({"_a": compare_key(F.coalesce("expected", F.lit(""))), "_b": compare_key(F.coalesce("found", F.lit("")))}), "_a", "_b", "_r")
    return rows.withColumns({"score": field_score(F.col("status"), F.col("_r")), "found": shown(F.col("status"), F.col("expected"), F.col("found"))}).drop("_a", "_b", "_r")


def total_check(premium: Column, discount: Column, total: Column, found_premium: Column, found_discount: Column) -> Column:
    """match if the record's total (or its premium less discount) is what the found premium and discount give."""
    want = F.coalesce(F.nullif(F.trim(total), F.lit("")), total_amount(premium, discount))
    return total_status(want, total_amount(found_premium, found_discount))


def total_status(want: Column, got: Column) -> Column:
    """match if the total that was found is there and is the one to be."""
    return F.when((got != "") & alike(want, got), "match").otherwise("mismatch")


def wrong_image(record_no: Column, text: Column) -> Column:
    """The record's digits stand nowhere among the digits of the text."""
    number = digits(F.coalesce(record_no, F.lit("")))
    return (number != "") & ~F.contains(digits(F.coalesce(text, F.lit(""))), number)


def form_summary(results: DataFrame, form: str = "form_id") -> DataFrame:
    """One row for each form: checked, matched, mismatched (with missed), overall_score, verdict.

    A partial aggregate per task goes before the shuffle, so a form of any number of fields is one row there.
    """
    checked = F.col("status") != "not_on_form"
    of = results.groupBy(form).agg(
        F.sum(checked.cast("int")).cast("long").alias("checked"),
        F.sum((F.col("status") == "match").cast("int")).cast("long").alias("matched"),
        F.sum(F.col("status").isin("mismatch", "ocr_missed").cast("int")).cast("long").alias("mismatched"),
    )
    score = F.when(F.col("checked") > 0, F.bround(100.0 * F.col("matched") / F.col("checked"), 1)).otherwise(0.0)
    return of.withColumns({"overall_score": score, "verdict": F.when(F.col("mismatched") == 0, "PASS").otherwise("FAIL")})


def fields_summary(fields: Column) -> list[Column]:
    """form_summary() of one form from its array of field results, as columns; null where there is none. The printed
    fields that the array leaves out, as nothing is known of them, match."""
    n = lambda *s: F.size(F.filter(fields, lambda f: f["status"].isin(*s)))
    known = F.size(F.filter(fields, lambda f: f["field"].isin(*PRINTED)))
    right = (n("match") + F.lit(len(PRINTED)) - known).cast("long")
    wrong = n("mismatch", "ocr_missed").cast("long")
    none = fields.isNull()
    of = {
        "checked": right + wrong, "matched_fields": right, "mismatched": wrong, "overall_score": F.bround(100.0 * right / (right + wrong), 1),
        "verdict": F.when(wrong == 0, "PASS").otherwise("FAIL"),
    }
    return [F.when(~none, c).alias(k) for k, c in of.items()]


def recomputed(results: DataFrame, form: str = "form_id") -> DataFrame:
    """The summary after results were edited: only matches and mismatches count, missed fields do not."""
    count = lambda s: F.sum((F.col("status") == s).cast("int")).cast("long")
    of = results.groupBy(form).agg(count("match").alias("matched"), count("mismatch").alias("mismatched"))
    of = of.withColumn("checked", F.col("matched") + F.col("mismatched"))
    score = F.when(F.col("checked") > 0, F.bround(100.0 * F.col("matched") / F.col("checked"), 1)).otherwise(0.0)
    return of.withColumns({"overall_score": score, "verdict": F.when(F.col("mismatched") == 0, "PASS").otherwise("FAIL")})


def filled(results: DataFrame, keep_status: bool = False) -> DataFrame:
    """Optional fallback, off by default in every query: found values that are empty become the expected ones.

    With keep_status only the value changes; else a mismatch with an expected value becomes a match, missed stay.
    """
    empty = F.coalesce(F.trim("found"), F.lit("")) == ""
    if keep_status:
        return results.withColumn("found", F.when(empty, F.col("expected")).otherwise(F.col("found")))
    change = empty & (F.col("status") == "mismatch") & (F.coalesce(F.trim("expected"), F.lit("")) != "")
    out = {"found": F.when(change, F.col("expected")).otherwise(F.col("found")), "status": F.when(change, "match").otherwise(F.col("status"))}
    return results.withColumns(out | ({"score": F.when(change, 100.0).otherwise(F.col("score"))} if "score" in results.columns else {}))


def reviewed(results: DataFrame, overrides: DataFrame, form: str = "form_id") -> DataFrame:
    """results with a reviewer's notes: a mismatch that has one becomes false_positive. Notes are unique by field."""
    marks = overrides.select(form, "field", "note").dropDuplicates([form, "field"])
    out = results.join(marks, [form, "field"], "left")
    return out.withColumn("status", F.when((F.col("status") == "mismatch") & F.col("note").isNotNull(), "false_positive").otherwise(F.col("status")))


def review_summary(results: DataFrame, form: str = "form_id") -> DataFrame:
    """The reviewer's verdict beside the engine's: missed fields do not count here, false positives count as right."""
    count = lambda *s: F.sum(F.col("status").isin(*s).cast("int")).cast("long")
    of = results.groupBy(form).agg(
        count("match", "mismatch", "false_positive").alias("checked"), count("match").alias("matched"), count("false_positive").alias("false_positives"),
        count("mismatch").alias("mismatched"), count("ocr_missed").alias("missed"),
    )
    right = F.col("matched") + F.col("false_positives")
    return of.withColumns({
        "review_score": F.when(F.col("checked") > 0, F.round(100.0 * right / F.col("checked"), 1)).otherwise(0.0),
        "verdict_review": F.when(F.col("mismatched") == 0, "PASS").otherwise("FAIL"),
        "verdict_api": F.when(F.col("mismatched") + F.col("false_positives") + F.col("missed") == 0, "PASS").otherwise("FAIL"),
    })
