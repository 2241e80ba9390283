"""Text normalisation as column expressions, all inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Glyphs that look alike and are compared as one.
ALIKE_FROM, ALIKE_TO = "L|O]Q", "II0JG"
# Quotation marks that output rows leave out.
QUOTES = "'\"‘’“”"


@lru_cache(1)
def accented() -> tuple[str, str]:
    """Letters of the basic plane that carry marks, and the letters without them."""
    pairs = []
    for cp in range(0xC0, 0x10000):
        if not 0xD800 <= cp < 0xE000:
            parts = unicodedata.normalize("NFD", chr(cp))
            plain = "".join(c for c in parts if unicodedata.category(c) != "Mn")
            if len(parts) > 1 and len(plain) == 1:
                pairs.append((chr(cp), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(c: Column) -> Column:
    """Letters without their marks: combining ones go, accented letters become plain. ASCII texts are taken as they are."""
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(F.translate(F.regexp_replace(c, r"\p{Mn}", ""), *accented()))


def collapse(c: Column) -> Column:
    """Upper case without accents, with single spaces between words."""
    return F.trim(F.regexp_replace(F.upper(strip_accents(c)), r"(?U)\s+", " "))


def compare_key(c: Column) -> Column:
    """What two values must share to be equal: no case, accents, spaces, dashes, commas, constant prefixes or
    differences between glyphs that look alike."""
    key = F.upper(F.regexp_replace(strip_accents(c), r"(?U)[\s\-,_]+", ""))
    key = F.regexp_replace(key, "^L(?=I@)", "")
    key = F.regexp_replace(key, "^[A-Z](?=[0-9]{5,}$)", "")
    return F.translate(key, ALIKE_FROM, ALIKE_TO)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def tokens(c: Column) -> Column:
    """Words of a text, in order."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def windows(words: Column, longest: int) -> Column:
    """All runs of one to `longest` words: array of struct(start, len, words joined by a space)."""
    starts = F.sequence(F.lit(0), F.size(words) - 1)
    lens = F.array(*map(F.lit, range(1, longest + 1)))
    one = lambda s: F.transform(
        F.filter(lens, lambda n: s + n <= F.size(words)),
        lambda n: F.struct(s.alias("start"), n.alias("len"), F.array_join(F.slice(words, s + 1, n), " ").alias("words")),
    )
    return F.when(F.size(words) > 0, F.flatten(F.transform(starts, one)))


def record_id(c: Column) -> Column:
    """The first four to six digits after an @ sign, or null."""
    return F.nullif(F.regexp_extract(c, "@\\s*([0-9]{4,6})", 1), F.lit(""))


def amount(c: Column) -> Column:
    """All digits of a text as one number, or null."""
    return F.nullif(digits(F.coalesce(c, F.lit(""))), F.lit("")).try_cast("bigint")


def total_amount(premium: Column, discount: Column) -> Column:
    """Premium less discount with a dollar sign; empty if either has no digits."""
    return F.coalesce(F.concat((amount(premium) - amount(discount)).cast("string"), F.lit("$")), F.lit(""))


def no_quotes(c: Column) -> Column:
    return F.translate(c, QUOTES, "")


def html_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def remarks(values: dict[str, Column]) -> Column:
    """Quality remarks on the values of a form, in field order and joined by commas."""
    notes = []
    for key, v in values.items():
        short = lambda n, v=v: (v != "") & (F.length(digits(v)) < n)
        if "phone" in key:
            notes.append(F.when(short(10), "PHONE NO. INVALID"))
        if "zip" in key:
            notes.append(F.when(short(5), "ZIP INVALID"))
        if key == "blood_group":
            notes.append(F.when(F.upper(v).isin("A", "B", "AB", "O"), "BLOOD GROUP SIGN MISSING"))
    return F.array_join(F.array(*notes), ", ") if notes else F.lit("")


def natural_key(c: Column) -> Column:
    """A sort key in which numbers inside names count by value, and case and accents do not."""
    folded = F.lower(strip_accents(c))
    parts = F.regexp_extract_all(folded, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=[0-9])", ""), 20, "0")).otherwise(p)), "")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, for short strings."""
    letters = lambda s: F.filter(F.split(s, ""), lambda x: x != "")
    right = letters(b)
    start = F.array_repeat(F.lit(0), F.size(right) + 1)

    def row(above: Column, ch: Column) -> Column:
        # cells of the next row, with the last one made kept beside the array
        grow = lambda acc, j: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), F.element_at(above, j + 1), F.when(F.element_at(right, j) == ch, F.element_at(above, j) + 1).otherwise(0))))
        return F.aggregate(F.when(F.size(right) > 0, F.sequence(F.lit(1), F.size(right))).otherwise(F.array().cast("array<int>")), F.array(F.lit(0)), grow)

    return F.element_at(F.aggregate(letters(a), start, row), -1)


def indel_ratio(a: Column, b: Column) -> Column:
    """Similarity of two short strings from 0 to 100: twice the common subsequence over both lengths."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, F.lit(100.0)).otherwise(F.lit(100.0) * 2 * lcs_length(a, b) / both)


def join_clean(parts: Sequence[Column]) -> Column:
    return F.concat_ws(" ", *(F.nullif(F.trim(p), F.lit("")) for p in parts))
