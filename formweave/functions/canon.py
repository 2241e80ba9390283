"""Canonical forms of field values, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .similarity import ratio
from .text import digits

# Fields with few possible values, and what these are.
CHOICES = {
    "payment_option": ["Credit Card", "Cash/Credit Card"],
    "card_type": ["Visa", "American Express", "MasterCard", "Discover", "Diners Club", "JCB", "Voyager", "enRoute"],
    "plan_name": [f"PLAN {c}" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"],
    "blood_group": ["A+", "A-", "B+", "B-", "AB+", "AB-", "O+", "O-"],
    "education": ["N.A."],
    "expiry_date": ["N.A."],
    "relation_with_nominee": ["N.A."],
}
# Fields that hold money, a number after a letter, a state; how alike a choice has to be.
MONEY = ["sum_of_insured", "premium", "discount"]
PREFIX = {"policy_no": "P", "card_no": "C"}
STATES = ["ph_state", "nominee_state", "agent_state"]
LEAST_ALIKE = 78.0


def nearest(options: list[str], v: Column) -> Column:
    """The most similar option (the first of equals) if it is similar enough, else v.

    The different values of an Arrow batch are compared once each, and only with options of a length that can do.
    """
    folded = [(o.upper(), o) for o in options]

    def best_of(x: str | None) -> str | None:
        rated = [(ratio(x, o), -i) for i, (o, _) in enumerate(folded) if 200.0 * min(len(x), len(o)) / (len(x) + len(o)) >= LEAST_ALIKE] if x else []
        r, i = max(rated, default=(0.0, 0))
        return folded[-i][1] if r >= LEAST_ALIKE else None

    @F.pandas_udf("string")
    def best(values: pd.Series) -> pd.Series:
        codes, different = pd.factorize(values, use_na_sentinel=True)
        of = pd.Series([best_of(x) for x in different] + [None], dtype=object)
        return of.iloc[codes].reset_index(drop=True)  # code -1 is null and the last

    return F.coalesce(best(F.upper(v)), v)


def canonical(key: str, value: Column) -> Column:
    """The canonical form of a field's value; empty values and those with a question mark stay."""
    v = F.trim(value)
    if key in CHOICES:
        new = nearest(CHOICES[key], v)
    elif key in MONEY:
        core = F.regexp_replace(v, "[$4]$", "")
        new = F.when(core.rlike("^[0-9]+$"), F.concat(core, F.lit("$"))).otherwise(v)
    elif key == "period_of_insurance":
        number = F.regexp_extract(v, "[0-9]+", 0)
        new = F.when(number != "", F.concat(number, F.lit(" Year"))).otherwise(v)
    elif key == "invoice_no":
        new = F.regexp_replace(v, r"(?i)^[L_I]*@[0-9]{4,6}\s*", "")
    elif key in STATES:
        letters = F.trim(F.regexp_replace(v, "^[^A-Za-z]+", ""))
        new = F.when(letters.rlike("^[A-Za-z]{2}$"), letters).otherwise(v)
    elif key in PREFIX:
        new = F.when(F.length(digits(v)) >= 6, F.concat(F.lit(f"{PREFIX[key]}-"), digits(v))).otherwise(v)
    else:
        new = v
    return F.when(F.coalesce(value, F.lit("")) == "", value).when(v.contains("?"), v).otherwise(new)
