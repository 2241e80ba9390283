"""How well a run of words fits a kind of field: one table of rules, read as column expressions, SQL and by kernels."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# For each kind the rules (least words, most words, feature, pattern, score), of which the first that
# holds counts, and the score if none does. `joined` is all words without spaces, `spaced` with one, in upper case.
ANY = 1 << 20
RULES: dict[str, tuple[list[tuple[int, int, str, str, float]], float]] = {
    "zip": ([(0, ANY, "joined", r"^[0-9]{5}(-[0-9]{2,4})?$", 95.0)], 8.0),
    "phone": ([(0, ANY, "joined", r"^[(]?[0-9]{3}[)]?[- ]?[0-9]{3}[- ]?[0-9]{4}$", 95.0)], 10.0),
    "date": ([(1, 1, "joined", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}$", 92.0)], 8.0),
    "email": ([(0, ANY, "joined", r"(@.*(TEST|MAIL)|(TEST|MAIL).*@)", 95.0)], 8.0),
    "na": ([(0, ANY, "joined", r"^(NA[.,]?|N[.,]A.*)$", 88.0)], 15.0),
    "money": ([(1, 1, "joined", r"^[0-9]{2,6}[$4]$", 90.0)], 8.0),
    "blood": (
        [(0, 0, "joined", "", 4.0), (3, ANY, "joined", "", 4.0), (1, 2, "joined", r"^(AB|A|B|O|0)[+-]$", 98.0), (1, 1, "joined", r"^(AB|A|B|O|0)[+-]*$", 75.0)],
        5.0,
    ),
    "policy": (
        [(0, 0, "joined", "", 6.0), (3, ANY, "joined", "", 6.0), (1, 2, "joined", r"^P-?[0-9]{6,}$", 95.0), (1, 2, "joined", r"^[0-9]{14,16}$", 90.0)],
        6.0,
    ),
    "card_no": ([(0, ANY, "joined", r"^C-?[0-9]{6,}$", 95.0)], 6.0),
    "code16": (
        [(1, 1, "joined", r"^([0-9]{13,18}|[A-Z]{13,18})$", 25.0), (1, 1, "joined", r"^[A-Z0-9]{13,18}$", 88.0)],
        18.0,
    ),
    "record": ([(0, ANY, "joined", "LIFEINS", 5.0), (1, 1, "joined", r"@[^0-9]{0,2}[0-9]{3,6}", 100.0)], 5.0),
    "invoice": ([(0, ANY, "joined", "(LIFEINS|MAX@)", 98.0)], 6.0),
    "customer": ([(0, 0, "joined", "", 10.0), (2, ANY, "joined", "", 10.0), (1, 1, "joined", "^[A-Z0-9]{5,9}$", 65.0)], 20.0),
    "file": ([(0, 0, "joined", "", 10.0), (2, ANY, "joined", "", 10.0), (1, 1, "joined", "^[A-Z0-9]{8,12}$", 60.0)], 18.0),
    "plan_code": ([(0, 0, "joined", "", 8.0), (2, ANY, "joined", "", 8.0), (1, 1, "joined", "^[A-Z0-9]{6,8}$", 65.0)], 18.0),
    "int:60:99": ([(1, 1, "joined", "^0*[6-9][0-9]$", 88.0), (1, 1, "joined", "^[0-9]+$", 30.0)], 8.0),
    "int:140:210": ([(1, 1, "joined", "^0*(1[4-9][0-9]|20[0-9]|210)$", 88.0), (1, 1, "joined", "^[0-9]+$", 30.0)], 8.0),
    "int:80:220": ([(1, 1, "joined", "^0*([89][0-9]|1[0-9][0-9]|2[01][0-9]|220)$", 88.0), (1, 1, "joined", "^[0-9]+$", 30.0)], 8.0),
    "plan_name": ([(0, ANY, "spaced", "PLAN", 95.0)], 8.0),
    "period": ([(0, ANY, "spaced", "YEAR", 93.0)], 8.0),
    "yesno": ([(1, 1, "joined", r"^[.,]*(NO|YES|N[.]A|NA)[.,]*$", 95.0)], 6.0),
    "payment": ([(0, ANY, "spaced", "(CREDIT|CASH)", 90.0)], 12.0),
    "state": ([(1, 1, "joined", "^[^A-Z]*[A-Z]{2}[.,]*$", 80.0)], 3.0),
}
# Words that end or belong to a street, and words that begin an address.
STREET = [
    "ST", "ST.", "STREET", "AVE", "AVE.", "AVENUE", "RD", "RD.", "ROAD", "BLVD", "DR", "DR.", "DRIVE", "LN", "LANE", "CT", "PL", "PL.", "WAY",
    "APT", "APT.", "BOX", "PO", "P.O.", "SUITE", "STE", "FLOOR", "HWY", "PKWY", "SQ", "TER", "CIR", "PLAZA", "N", "S", "E", "W", "NW", "NE", "SW", "SE",
]
OPENERS = ["PO", "P.O.", "P.O", "BOX", "POBOX", "P.O.BOX", "STE", "SUITE", "APT", "UNIT", "ATTN"]
WORD = r"^[A-Za-z][A-Za-z.'\-]*$"
#: Taken off for each word outside the usual range, and for each word more or less than usual.
OUTSIDE, UNUSUAL = 9.0, 1.5


def share(words: Column, test) -> Column:
    """Share of words that pass; 0 for none."""
    return F.when(F.size(words) > 0, F.size(F.filter(words, test)) / F.size(words)).otherwise(F.lit(0.0))


def score(kind: str, words: Column) -> Column:
    """The kind's score for an array of words."""
    trimmed = F.transform(words, lambda w: F.regexp_replace(F.upper(w), "^[.,]+|[.,]+$", ""))
    alpha, numbers = share(words, lambda w: w.rlike(WORD)), share(words, lambda w: w.rlike("[0-9]"))
    none = F.size(words) == 0
    if kind == "name":
        return 40 + 25 * alpha
    if kind == "city":
        return F.when(none, 0.0).when(trimmed[0].isin(STREET) | (numbers > 0), 16.0).otherwise(42 + 20 * alpha)
    if kind == "address":
        begins = F.when(words[0].rlike("[0-9]") | trimmed[0].isin(OPENERS), 28.0).otherwise(0.0)
        street = F.when(F.exists(trimmed, lambda w: w.isin(STREET)), 22.0).otherwise(0.0)
        ends = F.when(F.element_at(trimmed, -1).isin(STREET), 6.0).otherwise(0.0)
        return F.when(none, 0.0).otherwise(F.least(40.0 + begins + street + 6 * numbers + ends, F.lit(96.0)))
    rules, miss = RULES[kind]
    text = {"joined": F.upper(F.array_join(words, "")), "spaced": F.upper(F.array_join(words, " "))}
    out = None
    for least, most, feature, pattern, value in rules:
        holds = F.size(words).between(least, most) & text[feature].rlike(pattern or "^")
        out = F.when(holds, value) if out is None else out.when(holds, value)
    return out.otherwise(miss)


def score_sql(kind: str, words: str) -> str:
    """The same as SQL over a list of words."""
    n = f"len({words})"
    upper = f"list_transform({words}, lambda w: regexp_replace(upper(w), '^[.,]+|[.,]+$', '', 'g'))"
    part = lambda p: f"(CASE WHEN {n} > 0 THEN CAST(len(list_filter({words}, lambda w: regexp_matches(w, '{p}'))) AS DOUBLE) / {n} ELSE 0 END)"
    alpha, numbers = part(WORD.replace("'", "''")), part("[0-9]")
    listed = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    if kind == "name":
        return f"(40 + 25 * {alpha})"
    if kind == "city":
        return f"(CASE WHEN {n} = 0 THEN 0 WHEN list_contains({listed(STREET)}, {upper}[1]) OR {numbers} > 0 THEN 16 ELSE 42 + 20 * {alpha} END)"
    if kind == "address":
        begins = f"CASE WHEN regexp_matches({words}[1], '[0-9]') OR list_contains({listed(OPENERS)}, {upper}[1]) THEN 28 ELSE 0 END"
        street = f"CASE WHEN list_has_any({upper}, {listed(STREET)}) THEN 22 ELSE 0 END"
        ends = f"CASE WHEN list_contains({listed(STREET)}, {upper}[-1]) THEN 6 ELSE 0 END"
        return f"(CASE WHEN {n} = 0 THEN 0 ELSE least(40 + ({begins}) + ({street}) + 6 * {numbers} + ({ends}), 96) END)"
    rules, miss = RULES[kind]
    text = {"joined": f"upper(array_to_string({words}, ''))", "spaced": f"upper(array_to_string({words}, ' '))"}
    cases = " ".join(f"WHEN {n} BETWEEN {a} AND {b} AND regexp_matches({text[f]}, '{p}') THEN {v}" for a, b, f, p, v in rules)
    return f"(CASE {cases} ELSE {miss} END)"


@lru_cache(1 << 16)
def score_words(kind: str, words: tuple[str, ...], listed: frozenset[str] = frozenset()) -> float:
    """The same for one run of words inside a kernel; `listed` has known values of the kind, in upper case."""
    from .similarity import ratio

    n = len(words)
    trimmed = [w.upper().strip(".,") for w in words]
    alpha = sum(bool(re.match(WORD, w)) for w in words) / n if n else 0.0
    numbers = [bool(re.search("[0-9]", w)) for w in words]
    if kind == "name":
        return 40 + 25 * alpha
    if kind == "city":
        return 0.0 if not n else 16.0 if trimmed[0] in STREET or any(numbers) else 42 + 20 * alpha
    if kind == "address":
        if not n:
            return 0.0
        s = 40.0 + 28 * (numbers[0] or trimmed[0] in OPENERS) + 22 * any(t in STREET for t in trimmed)
        return min(96.0, s + 6 * sum(numbers) / n + 6 * (trimmed[-1] in STREET))
    if kind in ("card_type", "agent_name"):
        text = " ".join(words).upper()
        near = 100.0 if text in listed else max((ratio(text, v) for v in listed if abs(len(v) - len(text)) <= 3), default=0.0)
        if kind == "card_type":
            return max(near, 20 * alpha)
        tail = next((i for i, t in enumerate(reversed(trimmed)) if t not in STREET and t not in OPENERS), n)
        return max(0.95 * near, 42 + 18 * alpha) - 30 * sum(numbers) - 20 * tail
    if kind == "state" and n == 1 and re.sub("^[^A-Za-z]+", "", words[0]).upper().strip(".,") in listed:
        return 100.0
    rules, miss = RULES[kind]
    text = {"joined": "".join(words).upper(), "spaced": " ".join(words).upper()}
    return next((v for a, b, f, p, v in rules if a <= n <= b and re.search(p, text[f])), miss)


def field_score(kind: str, least: int, most: int, usual: int, words: tuple[str, ...], listed: frozenset[str] = frozenset()) -> float:
    """The kind's score less penalties for an unusual number of words; it can be negative."""
    n = len(words)
    return score_words(kind, words, listed) - OUTSIDE * max(0, least - n, n - most) - UNUSUAL * abs(n - usual)
