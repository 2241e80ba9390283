"""Whole forms from their parts: validated against records, or read out as rows of the output sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formweave.catalog import FIELDS, KEYS, ON_FORM
from formweave.functions.canon import canonical
from formweave.functions.similarity import with_ratios
from formweave.functions.text import compare_key, tokens, total_amount
from formweave.operators.alignment import LOCATED, align_forms, segment_forms
from formweave.operators.layout import union_box
from formweave.operators.matching import best_numbers
from formweave.operators.rows import wide_rows
from formweave.operators.stitch import classify, stitch_by_column, stitch_in_order, tied_parts
from formweave.operators.verdict import field_score, field_status, fields_summary, shown, total_status, wrong_image
from formweave.sources.sinks import dropped, kept

TOTAL = "total_amount"


BOXES = "array<struct<x0:double,y0:double,x1:double,y1:double>>"


def merged_forms(parts: DataFrame) -> DataFrame:
    """parts (folder, pos, text, col, image) as forms: form_id, folder, group_pos, parts, image of the last part, text.

    A form's parts are those that stitching by column puts together, in order; there are few of them. `members` has
    image, box (number of the crop, if parts have one) and first word of each; `boxes` those of all words, one part's
    after the other's, if parts have boxes.
    """
    ties = tied_parts(parts.select("folder", "pos", "text", "col"))
    has = lambda c, kind: F.col(c).cast(kind) if c in parts.columns else F.lit(None).cast(kind)
    rows = parts.select("folder", F.struct("folder", F.col("pos").cast("long").alias("pos")).alias("_at"), "image", "text", has("box", "long").alias("box"), has("boxes", BOXES).alias("boxes"))
    rows = rows.join(ties, "_at", "left").withColumn("group_pos", F.coalesce("group_pos", "_at.pos"))
    part = F.struct(F.col("_at.pos").alias("pos"), F.coalesce("text", F.lit("")).alias("text"), "image", "box", F.coalesce("boxes", F.array().cast(BOXES)).alias("boxes"))
    forms = rows.groupBy("folder", "group_pos").agg(F.array_sort(F.collect_list(part)).alias("p"))
    words = F.transform("p", lambda x: F.size(tokens(x["text"])))
    before = lambda i: F.aggregate(F.slice(words, 1, i), F.lit(0), lambda a, n: a + n)
    last = F.element_at("p", -1)
    return forms.select(
        "folder", "group_pos", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"), last["image"].alias("image"), F.size("p").cast("long").alias("parts"),
        F.transform("p", lambda x, i: F.struct(x["image"].alias("image"), x["box"].alias("box"), before(i).alias("first"))).alias("members"),
        F.flatten(F.transform("p", lambda x: x["boxes"])).alias("boxes"),
        F.concat_ws(":", F.col("folder").cast("string"), F.col("group_pos").cast("string")).alias("form_id"),
    )


def judged(forms: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """forms (form_id, text, record_no and a column for each known field) with `fields` in place of text, known fields and
    boxes: an array of struct(pos, field, expected, found, status, score, box, part) for the known fields and the total.

    Every field that is printed on forms and has a value is located in the text by alignment, all of them in one
    go; the total is checked against what premium and discount were found to be. If forms have boxes and members (as
    merged_forms gives them), a value that was read wrongly has `box`, around the boxes of its words, and `part`, the
    number of the member (from 0) where its first word stands. A form stays one row, so nothing is shuffled to judge it.
    """
    keys = [k for k in keys or KEYS if k in forms.columns]
    located, listed = [k for k in keys if k in ON_FORM], [k for k in keys if k != TOTAL]
    with_boxes = "boxes" in forms.columns and "members" in forms.columns
    rows = align_forms(forms, F.array(*(F.col(k) for k in located)), F.col("text"), located)
    none = F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")
    around = lambda s: union_box(F.slice("boxes", s["begin"] + 1, F.greatest(F.lit(0), s["end"] - s["begin"]))) if with_boxes else none
    owner = lambda s: F.size(F.filter("members", lambda m: m["first"] <= s["begin"])) - 1 if with_boxes else F.lit(None).cast("int")
    value = lambda k: F.col(k).cast("string") if k in keys else F.lit(None).cast("string")
    each = F.array(*(F.struct(F.lit(KEYS.index(k)).alias("pos"), F.lit(k).alias("field"), F.lit(k in ON_FORM).alias("on_form"), value(k).alias("expected")) for k in listed))
    rows = rows.withColumn("_span", F.map_from_entries(F.transform("spans", lambda s: F.struct(s["field"], s))))
    rows = rows.withColumn("_f", F.transform(each, lambda f: F.struct(f["pos"].alias("pos"), f["field"].alias("field"), f["on_form"].alias("on_form"), f["expected"].alias("expected"), F.col("_span")[f["field"]].alias("span"))))
    status = lambda f: field_status(f["expected"], f["span"]["found"], f["on_form"])
    rows = rows.withColumn("_f", F.transform("_f", lambda f: f.withField("status", status(f))))
    wrong = lambda f: f["status"] == "mismatch"
    box = lambda f: F.when(wrong(f), around(f["span"]))
    rows = rows.withColumn("_f", F.transform("_f", lambda f: f.withField("found", shown(f["status"], f["expected"], f["span"]["found"])).withField("box", box(f))))
    got = lambda k: F.col("_f")[listed.index(k)]["found"] if k in listed else F.lit("")
    p, d, t = value("premium"), value("discount"), value(TOTAL)
    want, sum_ = F.coalesce(F.nullif(F.trim(t), F.lit("")), total_amount(p, d)), total_amount(got("premium"), got("discount"))
    rows = rows.withColumn("_total", F.struct(want.alias("expected"), sum_.alias("found")))
    rows = rows.withColumn("_total", F.col("_total").withField("status", total_status(F.col("_total.expected"), F.col("_total.found"))))
    # Only keys that differ are compared letter by letter.
    differing = lambda c: F.concat(F.transform("_f", lambda f: F.when(wrong(f), compare_key(f[c]))), F.array(F.when(F.col("_total.status") == "mismatch", compare_key(F.col("_total")[c]))))
    rows = rows.withColumns({"_a": differing("expected"), "_b": differing("found")}).drop("_span", "spans", "text", "boxes", *listed, *({TOTAL} & set(keys)))
    rows = with_ratios(rows, "_a", "_b", "_r")
    result = lambda f, i: F.struct(
        f["pos"].alias("pos"), f["field"].alias("field"), f["expected"].alias("expected"), f["found"].alias("found"), f["status"].alias("status"), field_score(f["status"], F.col("_r")[i]).alias("score"),
        f["box"].alias("box"), F.when(f["box"].isNotNull(), owner(f["span"])).alias("part"),
    )
    of = lambda c: F.col("_total")[c].alias(c)
    found = F.when(F.col("_total.status") == "match", F.col("_total.expected")).otherwise(F.col("_total.found"))
    last = F.struct(F.lit(KEYS.index(TOTAL)).alias("pos"), F.lit(TOTAL).alias("field"), of("expected"), found.alias("found"), of("status"), field_score(F.col("_total.status"), F.col("_r")[len(listed)]).alias("score"), none.alias("box"), F.lit(None).cast("int").alias("part"))
    return rows.withColumn("fields", F.concat(F.transform("_f", result), F.array(last))).drop("_f", "_total", "_a", "_b", "_r")


def field_rows(forms: DataFrame, keys: list[str]) -> DataFrame:
    """The fields of judged forms (form_id, fields) as rows, one for each field of the catalog: those that are not known
    (not in keys) match if they are printed on forms."""
    kind = forms.schema["fields"].dataType.elementType
    rest = [(i, k, None, "", "match" if k in ON_FORM else "not_on_form", 100.0 if k in ON_FORM else None, None, None) for i, k in enumerate(KEYS) if k not in keys and k != TOTAL]
    others = F.array(*(F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, kind.fields))) for row in rest)) if rest else F.array().cast(forms.schema["fields"].dataType)
    rows = forms.select("form_id", F.explode(F.concat("fields", others)).alias("x"))
    of = lambda n, kind: F.get(F.array(*(F.lit(f[n]).cast(kind) for f in FIELDS)), F.col("x.pos"))
    return rows.select("form_id", "x.pos", of(1, "string").alias("serial"), "x.field", of(2, "string").alias("label"), (of(3, "boolean") | (F.col("x.field") == TOTAL)).alias("on_form"), "x.expected", "x.found", "x.status", "x.score", "x.box", "x.part")


def compared(forms: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """judged() forms as field rows with status, score and found."""
    return field_rows(judged(forms, keys).select("form_id", "fields"), [k for k in keys or KEYS if k in forms.columns])


def validate(parts: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """parts (folder, pos, text, col, image; box and boxes if known) validated against records (record_no, pos and any
    known fields).

    Gives forms (form_id, folder, image, parts, record_no, matched, checked, matched_fields, mismatched,
    overall_score, verdict, image_mismatch, sources) and field rows. Parts of one form are joined and matched with the
    record whose number stands in their header, not with one whose number is a part of that; it is filed under the image
    of its last part. Forms without a record have matched false and no verdict. sources has image and box of each part, and the fields read wrongly on it with
    the box around their words. Judged forms are written once to the shared folder, as both results come from them.
    """
    forms = kept(merged_forms(parts), "merged")
    named = best_numbers(forms.select(F.col("form_id").alias("id"), "text"), records, whole=True).select(F.col("id").alias("form_id"), "record_no")
    fields = [c for c in records.columns if c in KEYS and c != "record_no"]
    first = records.groupBy("record_no").agg(*(F.min_by(c, "pos").alias(c) for c in fields))
    known = forms.join(named.join(first, "record_no"), "form_id", "left").withColumn("matched", F.col("record_no").isNotNull())
    mismatch = F.when(F.col("matched"), wrong_image(F.col("record_no"), F.col("text")))
    known = known.select("form_id", "folder", "image", "parts", F.col("record_no").alias("_record_no"), "matched", mismatch.alias("image_mismatch"), "members", "text", "boxes", "record_no", *fields)
    done = kept(judged(known).withColumn("fields", F.when(F.col("matched"), F.col("fields"))).withColumnRenamed("_record_no", "record_no"), "judged")
    dropped(forms)
    wrong = lambda i: F.filter("fields", lambda f: f["part"] == i)
    on = lambda i: F.transform(F.coalesce(wrong(i), F.array().cast(done.schema["fields"].dataType)), lambda f: F.struct(f["field"].alias("field"), f["box"].alias("box")))
    sources = F.transform("members", lambda m, i: F.struct(m["image"].alias("image"), m["box"].alias("box"), on(i).alias("fields")))
    out = done.select("form_id", "folder", "image", "parts", "record_no", "matched", "image_mismatch", *fields_summary(F.col("fields")), sources.alias("sources"))
    return out, field_rows(done.where("matched").select("form_id", "fields"), ["record_no", *fields])


def extract(parts: DataFrame, listed: dict[str, set[str]] | None = None) -> DataFrame:
    """parts (folder, pos, text, col) as output rows (form_id, folder, pos, state, ID, a column for each field).

    Parts are joined by column, segmented by content alone, and values made canonical. state tells joined,
    complete and orphan rows from open ones, which a later batch may still complete.
    """
    return extract_rows(stitch_by_column(classify(parts)), listed)


def extract_rows(stitched: DataFrame, listed: dict[str, set[str]] | None = None) -> DataFrame:
    """Rows of the output sheet from texts of whole forms (folder, pos, text, state), batch or stream results alike."""
    forms = stitched.withColumn("form_id", F.concat_ws(":", F.col("folder").cast("string"), F.col("pos").cast("string")))
    found = segment_forms(forms.select("form_id", "text"), "text", listed)
    cells = [F.struct(F.lit(f[0]).alias("field"), canonical(f[0], F.col("values")[f[0]]).alias("value")) for f in LOCATED]
    rows = wide_rows(found.select("form_id", "text", F.explode(F.array(*cells)).alias("x")).select("form_id", "text", "x.*"))
    return forms.select("form_id", "folder", "pos", "state").join(rows, "form_id")


def extract_cell_rows(stitched: DataFrame, listed: dict[str, set[str]] | None = None) -> DataFrame:
    """Rows of the output sheet from cells of whole forms (folder, pos, cells, state): fields take whole cells."""
    forms = stitched.withColumn("form_id", F.concat_ws(":", F.col("folder").cast("string"), F.col("pos").cast("string"))).withColumn("text", F.array_join("cells", " "))
    found = segment_forms(forms.select("form_id", "text", "cells"), "cells", listed, cells=True)
    cells = [F.struct(F.lit(f[0]).alias("field"), canonical(f[0], F.col("values")[f[0]]).alias("value")) for f in LOCATED]
    rows = wide_rows(found.select("form_id", "text", F.explode(F.array(*cells)).alias("x")).select("form_id", "text", "x.*"))
    return forms.select("form_id", "folder", "pos", "state").join(rows, "form_id")


def stitch_cells(parts: DataFrame) -> DataFrame:
    """parts (folder, pos, cells: array of cell texts) joined first in, first out: folder, pos, cells, state.

    The queue works on the words of the cells; the cells of both halves stand one after the other in the result.
    """
    texts = parts.withColumn("text", F.array_join("cells", " "))
    kinds = classify(texts.select("folder", "pos", "text", "cells"))
    ends = "\u0001"  # between cells, so that a joined text still tells them apart
    joined = stitch_in_order(kinds.select("folder", "pos", "kind", F.concat(F.array_join("cells", ends), F.lit(ends)).alias("text")))
    cells = F.filter(F.transform(F.split("text", ends), lambda c: F.regexp_replace(c, "^ ", "")), lambda c: c != "")
    return joined.withColumn("cells", cells).select("folder", "pos", "cells", "state")


def as_cells(words: Column, boxes: Column, cells: Column) -> Column:
    """The cells of a crop, or one word each where words and boxes do not go together or there is no underline."""
    return F.when((F.size(words) != F.size(boxes)) | (F.size(cells) == 0), words).otherwise(cells)
