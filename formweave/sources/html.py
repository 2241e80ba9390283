"""Record pages: links, options and key-value tables taken out of HTML text by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain(c: Column) -> Column:
    """Text of a piece of HTML: no tags, the usual entities resolved, no outer spaces."""
    text = F.regexp_replace(c, "(?s)<[^>]*>", "")
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(ch))
    return F.trim(text)


def links(pages: DataFrame, prefix: str, base: str, inside: str | None = None) -> DataFrame:
    """page_id, n, url: targets of anchors that begin with prefix, in order, below base. With `inside` (the id of a
    table) only those in it; a page without it gives none."""
    html = F.col("html")
    if inside is not None:
        html = F.regexp_extract(html, rf"""(?is)<table[^>]*\bid=["']{inside}["'][^>]*>(.*?)</table>""", 1)
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\bhref=["']([^"']*)["']"""), F.lit(1))
    rows = pages.select("page_id", F.posexplode(F.filter(found, lambda x: F.startswith(x, F.lit(prefix)))).alias("n", "target"))
    url = F.when(F.col("target").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.col("target")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace("target", "^/+", "")))
    return rows.select("page_id", "n", url.alias("url"))


def options(pages: DataFrame, placeholder: str = "selectuser") -> DataFrame:
    """page_id, n, value, text of the options of a page but empty ones and the placeholder."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)(<option\b.*?</option>)"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(found).alias("n", "o"))
    value = F.regexp_extract("o", r"""(?i)\bvalue=["']([^"']*)["']""", 1)
    return rows.select("page_id", "n", value.alias("value"), plain(F.col("o")).alias("text")).where(~F.col("value").isin("", placeholder))


def key_values(pages: DataFrame) -> DataFrame:
    """page_id, record map<string,string> of rows with three cells or more (number, key, value), after the first row.

    Keys are lower-case with _ for spaces; the later of equal keys counts. A row that lacks its opening tag begins
    with its first cell, after the row before has closed.
    """
    text = F.regexp_replace("html", r"(?i)(</tr>\s*)(<td)", "$1<tr>$2")
    rows = F.filter(F.split(text, r"(?i)<tr\b[^>]*>"), lambda r: F.contains(F.lower(r), F.lit("</t")))
    cells = lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1))
    # What is used several times is exploded from an array of one: expressions are not merged across that, so that a page is
    # taken apart once and not again for each mention.
    once = lambda df, c, name: df.select("page_id", F.explode(F.array(c)).alias(name))
    split = once(pages, rows, "_rows")
    body = F.slice("_rows", 2, F.greatest(F.size("_rows") - 1, F.lit(0)))
    pairs = F.transform(F.filter(F.transform(body, cells), lambda c: F.size(c) >= 3), lambda c: F.struct(F.replace(F.lower(plain(c[1])), F.lit(" "), F.lit("_")).alias("k"), plain(c[2]).alias("v")))
    found = once(split, pairs, "_pairs")
    last = F.filter("_pairs", lambda p, i: ~F.exists(F.slice("_pairs", i + 2, F.size("_pairs")), lambda q: q["k"] == p["k"]))
    return found.select("page_id", F.map_from_entries(last).alias("record"))
