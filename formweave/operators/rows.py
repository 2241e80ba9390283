"""Output rows and sheets: wide rows with remarks, sorting, column widths, sheet names, folders, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from formweave.catalog import KEYS, LABEL, ON_FORM
from formweave.functions.text import html_escape, natural_key, no_quotes, record_id, remarks, total_amount
from formweave.operators.ordered import numbered

OUTPUT = [k for k in KEYS if k != "form_no"]
WIDEST, NAME_LENGTH = 42, 31


def wide_rows(values: DataFrame, form: str = "form_id", text: str = "text") -> DataFrame:
    """One row for each form from values (form, field, value) and its text: ID, then a column for each output field.

    Values lose quotation marks; the record number comes from the text where it has one; the total is premium less
    discount; fields that are not on the form stay empty, and remark has the quality remarks. The pivot has a fixed
    list of fields, so it is one aggregation.
    """
    clean = values.withColumn("value", no_quotes(F.trim(F.coalesce("value", F.lit("")))))
    wide = clean.groupBy(form, text).pivot("field", [k for k in OUTPUT if k in ON_FORM]).agg(F.first("value"))
    cell = {k: F.coalesce(F.col(k), F.lit("")) for k in OUTPUT if k in ON_FORM}
    rid = F.coalesce(record_id(F.col(text)), F.lit(""))
    out = {k: cell.get(k, F.lit("")) for k in OUTPUT}
    out["record_no"] = F.when(rid != "", F.concat(F.lit("L_I@"), rid)).otherwise(cell["record_no"])
    out["total_amount"] = total_amount(cell["premium"], cell["discount"])
    out["remark"] = remarks(cell)
    return wide.select(F.col(form), rid.alias("ID"), *(v.alias(k) for k, v in out.items()))


def labelled(rows: DataFrame) -> DataFrame:
    """The same columns under the labels of the sheet."""
    return rows.select("ID", *(F.col(k).alias(LABEL[k]) for k in OUTPUT))


def row_order(pos: str, name: str = "ID") -> list[str | Column]:
    """Numeric IDs by value first, others after them; otherwise as they came."""
    number = F.col(name).rlike("^[0-9]+$")
    return [F.when(number, 0).otherwise(1), F.when(number, F.col(name).cast("decimal(38,0)")), F.col(pos)]


def sort_rows(rows: DataFrame, pos: str, name: str = "ID") -> DataFrame:
    """rows in the order of row_order()."""
    return rows.orderBy(*row_order(pos, name))


def numbered_rows(rows: DataFrame, pos: str, name: str = "ID") -> DataFrame:
    """rows with `place` in that order, from 1: ranges are numbered by themselves, after the counts of those before."""
    return numbered(rows, row_order(pos, name))


def sheet_widths(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, width: the longest text or header and two more, at most WIDEST."""
    text = rows.select(*(F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns))
    most = text.agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in columns))
    long = most.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.greatest(F.col(c), F.lit(len(c))).alias("n")) for c in columns))).alias("x"))
    return long.select("x.column", F.least(F.col("x.n") + 2, F.lit(WIDEST)).alias("width"))


def numeric_id(c: Column) -> Column:
    """The ID as a number where it is one, for the sheet's cell type."""
    return F.when(F.trim(c) != "", F.trim(c).try_cast("double"))


def sheet_names(folders: DataFrame, pos: str = "pos") -> DataFrame:
    """folders (name, pos) with sheet: forbidden marks out, 31 characters, later ones alike numbered from 2.

    Numbered names do not meet other names as long as these do not end in a number in parentheses themselves.
    """
    clean = F.substring(F.trim(F.regexp_replace("name", r"[\\/?*\[\]:]", "")), 1, NAME_LENGTH)
    named = folders.withColumn("base", F.when(clean == "", "Sheet").otherwise(clean))
    n = F.row_number().over(W.partitionBy(F.lower("base")).orderBy(pos))
    suffix = F.concat(F.lit(" ("), n.cast("string"), F.lit(")"))
    cut = F.expr(f"substring(base, 1, {NAME_LENGTH} - length(suffix))")
    return named.withColumns({"n": n, "suffix": suffix}).withColumn("sheet", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat(cut, "suffix"))).drop("base", "suffix", "n")


def folder_of(path: Column) -> Column:
    """The path that directly holds a file; loose files are in (files)."""
    return F.coalesce(F.nullif(F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.lit("")), F.lit("(files)"))


def folders(files: DataFrame, path: str = "path") -> DataFrame:
    """folder, label, files (number), in natural order by place."""
    of = files.withColumn("folder", folder_of(F.col(path))).groupBy("folder").agg(F.count("*").alias("files"))
    label = F.regexp_extract("folder", "([^/]*)$", 1)
    return of.select("folder", label.alias("label"), "files", F.row_number().over(W.orderBy(natural_key(F.col("folder")), "folder")).alias("place"))


def batch_totals(forms: DataFrame) -> DataFrame:
    """forms (folder, image, matched, passed) by image, by folder and overall: one aggregation with grouping sets."""
    of = forms.rollup("folder", "image").agg(
        F.count("*").alias("forms"), F.sum(F.col("matched").cast("long")).alias("matched"), F.sum(F.col("passed").cast("long")).alias("passed"), F.grouping_id().cast("int").alias("level")
    )
    return of.select("folder", "image", "forms", "matched", "passed", "level")


UNMATCHED = "This form could not be matched to any record: its record number could not be read or is not known."


def unmatched_report(forms: DataFrame, form: str = "form_id", message: str = UNMATCHED) -> DataFrame:
    """form, html: the body of the report for forms (image, box, text) without a record: where it stands, why there is
    no verdict, and the text that was read, if any. Boxes count from 0, forms of a report from 1; null is the first."""
    safe = lambda c: html_escape(F.coalesce(F.col(c).cast("string"), F.lit("")))
    head = F.concat(F.lit("<h2>Form "), safe(form), F.lit("</h2><p>Image: "), safe("image"), F.lit(" | Form #"), (F.coalesce("box", F.lit(0)) + 1).cast("string"), F.lit("</p><p>NOT MAPPED</p><p>"), html_escape(F.lit(message)), F.lit("</p>"))
    read = F.when(F.coalesce("text", F.lit("")) != "", F.concat(F.lit("<h3>Text read from the form</h3><pre>"), safe("text"), F.lit("</pre>"))).otherwise("")
    return forms.select(form, F.concat(head, read).alias("html"))


def report_lines(results: DataFrame, form: str = "form_id") -> DataFrame:
    """form, html: a table row for each field of each form, escaped, and a header with the counts."""
    cell = lambda c: F.concat(F.lit("<td>"), html_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), *(cell(c) for c in ("serial", "label", "expected", "found", "status")), F.lit("</tr>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", row.alias("row")))), lambda x: x["row"]), "")
    head = F.concat(F.lit("<h2>Form "), html_escape(F.col(form).cast("string")), F.lit("</h2><table>"))
    return results.groupBy(form).agg(body.alias("body")).select(form, F.concat(head, "body", F.lit("</table>")).alias("html"))
