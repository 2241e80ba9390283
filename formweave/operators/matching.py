"""Joins by content: the record a text belongs to, and the known value nearest to a word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from formweave.functions.similarity import with_ratio
from formweave.functions.text import digits, indel_ratio
from formweave.operators.ordered import in_blocks, running

#: A number has to stand at least so often in the header of a form.
LEAST_TIMES = 2
#: Values whose lengths differ by more are not compared.
BAND = 3
#: Words of a form in which tokens and parts meet.
STRETCH = 64


def header_digits(text):
    """All digits of the first two lines that are not blank."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return digits(F.array_join(F.slice(lines, 1, 2), ""))


def times(inside, number):
    """How often a number stands in a run of digits, without overlaps."""
    return ((F.length(inside) - F.length(F.replace(inside, number, F.lit("")))) / F.length(number)).cast("int")


def best_numbers(texts: DataFrame, records: DataFrame, pos: str = "pos", whole: bool = False) -> DataFrame:
    """id, record_no and n for texts (id, text) in whose header the digits of a record stand twice at least: the record
    whose digits stand most often.

    Of equals the first in store order counts; with `whole` the longest number, as 60016 also stands wherever 160016 does,
    and only then the first. Instead of comparing all pairs, the header's digit runs of the lengths that records have are
    counted, and those that stand often enough joined with the numbers by hash.
    """
    numbers = records.select("record_no", F.col(pos).alias("p"), digits(F.coalesce("record_no", F.lit(""))).alias("d")).where("d <> ''")
    numbers = numbers.groupBy("d").agg(F.min_by("record_no", "p").alias("record_no"), F.min("p").alias("p"))
    lengths = numbers.select(F.length("d").alias("n")).distinct()  # at most as many as the longest number has digits
    heads = texts.select("id", header_digits(F.coalesce("text", F.lit(""))).alias("h"))
    runs = heads.join(F.broadcast(lengths.agg(F.array_sort(F.collect_set("n")).alias("ns"))))
    runs = runs.select("id", "h", F.explode("ns").alias("n")).where("length(h) >= 2 * n")
    # A run stands twice where it comes again after its end.
    at = F.sequence(F.lit(1), F.length("h") - 2 * F.col("n") + 1)
    again = F.filter(at, lambda i: F.call_function("locate", F.substring(F.col("h"), i, F.col("n")), F.col("h"), i + F.col("n")) > 0)
    runs = runs.select("id", "h", F.explode(F.array_distinct(F.transform(again, lambda i: F.substring(F.col("h"), i, F.col("n"))))).alias("d"))
    runs = runs.select("id", "d", times(F.col("h"), F.col("d")).alias("n")).where(F.col("n") >= LEAST_TIMES)
    best = runs.join(numbers, "d").groupBy("id").agg(F.max_by(F.struct("record_no", "n"), F.struct("n", F.length("d") if whole else F.lit(0), -F.col("p"))).alias("b"))
    return best.select("id", "b.record_no", "b.n")


def match_by_number(texts: DataFrame, records: DataFrame, pos: str = "pos", whole: bool = False) -> DataFrame:
    """texts (id, text) with record_no and n of best_numbers(), null where there is none."""
    return texts.join(best_numbers(texts, records, pos, whole), "id", "left")


def nearest_values(words: DataFrame, vocabulary: DataFrame, short: bool = False) -> DataFrame:
    """words (key, word) with score: 100 for a known value of the key, else the best similarity to one of nearly the
    same length, 0 if there is none.

    Exact hits go out by a hash join first; the rest meets values by key and length, seven lengths each. `short`
    compares with expressions alone, which suits short strings.
    """
    asked = words.select("key", F.upper("word").alias("w")).distinct()
    known = vocabulary.select("key", F.col("value").alias("v"))
    exact = asked.join(known, (asked["key"] == known["key"]) & (asked["w"] == known["v"]), "left_semi")
    rest = asked.join(exact, ["key", "w"], "left_anti")
    banded = rest.withColumn("n", F.explode(F.sequence(F.length("w") - BAND, F.length("w") + BAND)))
    pairs = banded.join(known.withColumn("n", F.length("v")), ["key", "n"]).select("key", "w", "v")
    rated = pairs.withColumn("ratio", indel_ratio(F.col("w"), F.col("v"))) if short else with_ratio(pairs, "w", "v")
    best = rated.groupBy("key", "w").agg(F.max("ratio").alias("score")).union(exact.withColumn("score", F.lit(100.0)))
    out = words.withColumn("w", F.upper("word")).join(best, ["key", "w"], "left").drop("w")
    return out.withColumn("score", F.coalesce("score", F.lit(0.0)))


def nearest_underline(words: DataFrame, lines: DataFrame) -> DataFrame:
    """words (page, word, x0, y0, x1, y1) with the underline just below each (line, or null): the nearest, then first.

    Pages are the equality of the join; a page's words and lines are few.
    """
    b = lines.select("page", "line", *(F.col(c).alias(f"l{c}") for c in ("x0", "y0", "x1")))
    tall = F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
    gap = F.col("ly0") - F.col("y1")
    over = F.least("x1", "lx1") - F.greatest("x0", "lx0") > 0
    near = words.join(b, "page").where(over & gap.between(-0.3 * tall, 1.2 * tall))
    best = near.groupBy("page", "word").agg(F.min_by("line", F.struct(F.abs(gap).alias("g"), F.col("line"))).alias("line"))
    return words.join(best, ["page", "word"], "left")


def cells(words: DataFrame) -> DataFrame:
    """words (page, word, text, line) as cells: neighbours over one underline together, others alone."""
    w = W.partitionBy("page").orderBy("word")
    new = F.col("line").isNull() | F.lag("line").over(w).isNull() | (F.lag("line").over(w) != F.col("line"))
    numbered = words.withColumn("cell", F.sum(new.cast("int")).over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda x: x["text"]), " ")
    return numbered.groupBy("page", "cell").agg(joined.alias("text"))


def owner_of_tokens(tokens_: DataFrame, parts: DataFrame) -> DataFrame:
    """tokens_ (form, token) with the part (form, part, words) that each came from, by running word offsets.

    Offsets come from blocks, and a token meets the parts that lie in its stretch of STRETCH words, so that a form of any
    length is many join keys.
    """
    size = F.coalesce("words", F.lit(0))
    upto = running(in_blocks(parts.select("form", "part", size.alias("words")), ["form"], ["part"], "parts"), ["part"], F.col("words"), "end")
    spans = upto.where("words > 0").withColumn("begin", F.col("end") - F.col("words"))
    spans = spans.select("form", "part", "begin", "end", F.explode(F.sequence(F.floor(F.col("begin") / STRETCH), F.floor((F.col("end") - 1) / STRETCH))).alias("at"))
    t, s = tokens_.withColumn("at", F.floor(F.col("token") / STRETCH)).alias("t"), spans.alias("s")
    on = (F.col("t.form") == F.col("s.form")) & (F.col("t.at") == F.col("s.at")) & (F.col("t.token") >= F.col("s.begin")) & (F.col("t.token") < F.col("s.end"))
    return t.join(s, on, "left").select("t.form", "t.token", "s.part")
