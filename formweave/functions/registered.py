"""The library's functions under names that SQL knows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formweave.catalog import ON_FORM
from formweave.functions import similarity
from formweave.functions.text import ALIKE_FROM, ALIKE_TO, accented
from formweave.operators.alignment import LOCATED, align_all, segment

STRIP = "CASE WHEN x RLIKE r'^[\\x00-\\x7F]*$' THEN x ELSE translate(regexp_replace(x, r'\\p{{Mn}}', ''), '{0}', '{1}') END"
KEY = (
    r"translate(regexp_replace(regexp_replace(upper(regexp_replace(strip_accents(x), r'(?U)[\s\-,_]+', '')), r'^L(?=I@)', ''), r'^[A-Z](?=[0-9]{5,}$)', ''), '%s', '%s')"
    % (ALIKE_FROM, ALIKE_TO)
)


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else similarity.ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("diff", T.BooleanType())])))
def char_diff(expected: pd.Series, found: pd.Series) -> pd.Series:
    return pd.Series([similarity.differences(x or "", y or "") for x, y in zip(expected, found)])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def align_form(expected: pd.Series, words: pd.Series) -> pd.Series:
    forms = [([x for x in e if x] if e is not None else [], list(w) if w is not None else []) for e, w in zip(expected, words)]
    return pd.Series([[{"begin": b, "end": e} for b, e in runs] for runs in align_all(forms)])


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def segment_form(words: pd.Series) -> pd.Series:
    most, out = sum(f[5] + 1 for f in LOCATED), []
    for w in words:
        w = list(w) if w is not None else []
        runs, fits = segment(w) if len(w) <= most else ([(0, 0)] * len(ON_FORM), False)
        out.append({f[0]: " ".join(w[b:e]) if fits else "" for f, (b, e) in zip(LOCATED, runs)})
    return pd.Series(out)


def register(spark: SparkSession) -> None:
    """strip_accents and compare_key are SQL expressions; indel_ratio, char_diff, align_form (array of expected values,
    array of words, both without case and accents) and segment_form (array of words) work on Arrow batches."""
    quoted = [x.replace("\\", "\\\\").replace("'", "\\'") for x in accented()]
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION strip_accents(x STRING) RETURNS STRING RETURN {STRIP.format(*quoted)}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION compare_key(x STRING) RETURNS STRING RETURN {KEY}")
    for f in (indel_ratio, char_diff, align_form, segment_form):
        spark.udf.register(f.__name__, f)
