"""Fields found between strong anchors of a text (mail address, policy and card numbers, answers), in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formweave.functions.text import total_amount

# States and card types that are looked for, and the questions in the order of their answers.
STATES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA",
    "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK",
    "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC", "NA",
]
CARDS = ["Cash-Credit Card", "American Express", "MasterCard", "Visa", "Diners Club", "Credit Card"]
QUESTIONS = ["q1_alcohol", "q2_medication", "q3a_hypertension", "q3b_diabetes", "q3c_cardiovascular", "q3d_genitourinary", "q4_hiv", "q5_other_insurance", "q6_involved_pursue", "q7_glasses"]
# Shapes of the anchors.
EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"
POLICY, CARD_NO = "P-[A-Za-z0-9]{10,}", "C-[0-9]{10,}"
DATE, ZIP, PHONE = "[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", r"\b[0-9]{5}(?:-[0-9]{4})?\b", r"[(]?[0-9]{3}[)]?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}"
LONG_CODE = r"\b[A-Za-z0-9]{10,}\b"
RECORD, INVOICE = r"(?i:L[-_\s]?[I1][@\s]?[0-9]{4,6})", "21-[0-9]{4,6}"
CUSTOMER, FILE_NO = r"\b[A-Za-z0-9]{5,10}\b", r"\b[A-Za-z0-9]{6,16}\b"
WORD, MEASURE = "(?i:N[.]A[.]|[A-Za-z]{2,})", r"\b[0-9]{2,3}\b"
BLOOD, HOLDER = r"\b(?:AB|A|B|O)[+-]", r"(?i:N[.]A[.]|[A-Za-z?][A-Za-z0-9?.\s]{2,40})"


def first(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(c, f"({pattern})" if not group else pattern, max(group, 1) if group else 1)


def every(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))


def before(c: Column, found: Column) -> Column:
    """The text before the first place of `found`; all of it if that is empty."""
    return F.when(found == "", c).otherwise(F.split_part(c, found, F.lit(1)))


def after(c: Column, found: Column) -> Column:
    """The text after the first place of `found`; nothing if that is empty."""
    return F.when(found == "", F.lit("")).otherwise(F.substring(c, F.instr(c, found) + F.length(found), F.length(c)))


def past(c: Column, pattern: str) -> Column:
    """The text after the first match of a pattern; all of it if there is none."""
    return F.regexp_replace(c, f"(?s)^.*?(?:{pattern})", "")


def without(c: Column, found: Column) -> Column:
    """c with the first place of `found` made a space."""
    return F.when(found == "", c).otherwise(F.concat(before(c, found), F.lit(" "), after(c, found)))


def answers(c: Column) -> Column:
    """All yes and no in order, with a capital."""
    return F.transform(every(c, r"(?i:\b(?:Yes|No)\b)"), lambda x: F.initcap(x))


def state(c: Column) -> Column:
    """The first known state code that stands alone."""
    return F.coalesce(F.get(F.filter(F.split(c, r"[^\p{L}\p{N}_]+"), lambda x: x.isin(STATES)), 0), F.lit(""))


def anchored(forms: DataFrame, text: str = "text") -> DataFrame:
    """forms with a column for each field that stands by an anchor; what is not found is empty.

    A field is looked for in its own section: before the mail address, from there to the policy number, to the first
    answer, to the card number, and after it. Missing anchors put a section's end at the end of the text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    # the invoice number has an @ too, but its domain is the insurer's
    email = F.coalesce(F.get(F.filter(every(t, EMAIL), lambda x: ~x.contains("@LifeIns")), 0), F.lit(""))
    marks = {"ph_email": email, "policy_no": first(t, POLICY), "card_no": first(t, CARD_NO), "_yes": first(t, r"(?i:\b(?:Yes|No)\b)")}
    df = forms.withColumns({k: v for k, v in marks.items()})
    head = before(t, F.col("ph_email"))
    middle = before(after(t, F.col("ph_email")), F.col("policy_no"))
    agent = before(after(t, F.col("policy_no")), F.col("_yes"))
    pay = F.element_at(F.split(before(t, F.col("card_no")), r"(?i:\b(?:Yes|No)\b)"), -1)
    df = df.withColumns({"_head": head, "_middle": F.trim(middle), "_agent": agent, "_pay": pay, "_last": after(t, F.col("card_no"))})
    # after both numbers and the date come two codes, then the holder's name and address
    df = df.withColumn("_after", past(past(past(F.col("_head"), RECORD), f"{RECORD}|{INVOICE}"), DATE))
    df = df.withColumns({"customer_id": first(F.col("_after"), CUSTOMER), "_file": past(F.col("_after"), CUSTOMER)})
    df = df.withColumns({"file_no": first(F.col("_file"), FILE_NO), "_block": F.trim(past(F.col("_file"), FILE_NO))})
    h, m, a, p, z = (F.col(c) for c in ("_head", "_middle", "_agent", "_pay", "_last"))
    ids = F.regexp_extract_all(t, F.lit(r"(?i)L[-_\s]?[I1][@\s]?([0-9]{4,6})"), F.lit(1))
    number = lambda i: F.coalesce(F.concat(F.lit("L_I@"), F.try_element_at(ids, F.lit(i))), F.lit(""))
    second = lambda c, pattern, n: F.coalesce(F.try_element_at(every(c, pattern), F.lit(n)), F.lit(""))
    codes = every(F.col("_codes"), LONG_CODE)
    money = lambda n: second(p, "[0-9][0-9,]*[$]", n)
    fields = {
        "record_no": number(1),
        "invoice_no": F.when(number(2) != "", number(2)).otherwise(first(h, "L-Max@LifeIns_21-[0-9]{4,6}")),
        "date_of_purchase": first(h, DATE),
        "ph_dob": first(m, DATE),
        "blood_group": first(m, BLOOD),
        "reference_no": first(a, LONG_CODE),
        "plan_name": F.when(first(a, r"(?i:\bPLAN\s+[A-Z]\b)") != "", F.upper(F.regexp_replace(first(a, r"(?i:\bPLAN\s+[A-Z]\b)"), r"\s+", " "))).otherwise(""),
        "plan_code": first(after(a, first(a, r"(?i:\bPLAN\s+[A-Z]\b)")), r"\b[A-Za-z0-9]{3,}\b"),
        "sum_of_insured": first(a, "[0-9][0-9,]*[$]"),
        "period_of_insurance": F.when(first(a, r"(?i:[0-9]+\s*Year)") != "", F.concat(F.regexp_extract(a, r"(?i)([0-9]+)\s*Year", 1), F.lit(" Year"))).otherwise(""),
        "payment_option": first(p, r"(?i:Cash[-\s]?Credit\s+Card|Credit\s+Card|Cheque|enRoute)"),
        "premium": money(1),
        "discount": money(2),
        "card_type": F.coalesce(*(F.when(F.lower(p).contains(x.lower()), x) for x in CARDS), F.lit("")),
        "expiry_date": first(z, "N[.]A[.]|[A-Za-z0-9./]{3,8}"),
        "transaction_id": first(z, LONG_CODE),
    }
    df = df.withColumn("_codes", before(after(a, first(a, LONG_CODE)), first(a, r"(?i:\bPLAN\s+[A-Z]\b)")))
    size = F.size(codes)
    fields["agent_code"] = F.when(size >= 2, F.element_at(codes, -2)).when(size == 1, F.element_at(codes, 1)).otherwise("")
    fields["agent_licence_no"] = F.when(size >= 2, F.element_at(codes, -1)).otherwise("")
    said = answers(t)
    fields |= {q: F.coalesce(F.try_element_at(said, F.lit(i + 1)), F.lit("")) for i, q in enumerate(QUESTIONS)}
    df = df.withColumns({k: F.trim(v) for k, v in fields.items()})
    df = df.withColumn("total_amount", total_amount(F.col("premium"), F.col("discount")))
    df = nominee(card_holder(split_holder(df, "_block", "ph_")))
    # the agent's name and address are what the codes, zip and state leave
    df = df.withColumn("_codes", without(without(F.col("_codes"), F.col("agent_code")), F.col("agent_licence_no")))
    df = three_parts(df, "_codes", "agent_")
    return df.drop("_yes", "_head", "_middle", "_agent", "_pay", "_last", "_codes", "_block", "_after", "_file")


def three_parts(df: DataFrame, block: str, prefix: str) -> DataFrame:
    """df with zip, state, name, address and city (under prefix) of a block: zip and state come out first."""
    df = df.withColumn(f"{prefix}zip", first(F.col(block), ZIP))
    df = df.withColumns({f"{prefix}state": state(F.col(block)), "_rest": without(F.col(block), F.col(f"{prefix}zip"))})
    df = split_address(df.withColumn("_rest", without_word(F.col("_rest"), F.col(f"{prefix}state"))), "_rest", "_split")
    return df.withColumns({f"{prefix}{c}": F.col(f"_split.{c}") for c in ("name", "address", "city")}).drop("_rest", "_split")


def without_word(c: Column, word: Column) -> Column:
    """c with the first place of a word that stands alone made a space; all of c if the word is empty."""
    gone = F.regexp_replace(c, F.concat(F.lit(r"(?s)^(.*?)\b"), word, F.lit(r"\b")), F.lit("$1 "))
    return F.when(word == "", c).otherwise(gone)


def nominee(df: DataFrame) -> DataFrame:
    """df (_middle) with education and the nominee's fields, which stand between it and the blood group."""
    m = F.col("_middle")
    df = df.withColumn("_edu", F.when(first(m, DATE) != "", after(m, first(m, DATE))).otherwise(m))
    df = df.withColumns({"education": first(F.col("_edu"), WORD), "_nom": F.when(first(F.col("_edu"), WORD) != "", past(F.col("_edu"), WORD)).otherwise(F.col("_edu"))})
    df = df.withColumn("_nom", F.trim(F.regexp_extract(F.col("_nom"), r"(?s)^(.*?)(?:\b(?:AB|A|B|O)[+-].*)?$", 1)))
    n, z = F.col("_nom"), F.col("nominee_zip")
    df = df.withColumns({"nominee_zip": first(n, ZIP), "nominee_state": state(n)})
    zone = F.when(z != "", after(n, z)).otherwise(F.substring(n, -20, 20))
    df = df.withColumn("relation_with_nominee", first(zone, "(?i:N[.]A[.]|[A-Za-z]+)"))
    df = df.withColumn("_nom", without(without_word(without(n, z), F.col("nominee_state")), F.col("relation_with_nominee")))
    df = df.withColumn("_sizes", every(F.col("_nom"), MEASURE))
    s, k = F.col("_sizes"), F.size("_sizes")
    at = lambda i: F.coalesce(F.try_element_at(s, F.lit(i)), F.lit(""))
    df = df.withColumns({
        "chest": F.when(k >= 3, at(-3)).otherwise(""), "height": F.when(k >= 3, at(-2)).when(k == 2, at(1)).otherwise(""), "weight": F.when(k >= 3, at(-1)).when(k == 2, at(2)).otherwise(""),
    })
    rest = F.col("_nom")
    for c in ("chest", "height", "weight"):
        df = df.withColumn("_nom", without(rest, F.col(c)))
    df = split_address(df, "_nom", "_split")
    return df.withColumns({f"nominee_{c}": F.col(f"_split.{c}") for c in ("name", "address", "city")}).drop("_edu", "_nom", "_sizes", "_split")


def card_holder(df: DataFrame) -> DataFrame:
    """df (_last) with the name after the expiry date, without a code that follows it."""
    rest = past(F.col("_last"), "(?i:N[.]A[.]|[A-Za-z0-9./]{3,8})")
    found = F.trim(first(rest, HOLDER))
    return df.withColumn("card_holder_name", F.trim(F.regexp_replace(found, r"\s+[A-Za-z0-9]{10,}$", "")))


# Words of addresses, as plain lists in their usual order.
STREETS = [
    "avenue of the americas", "street dr", "st dr", "street", "road", "avenue", "boulevard", "drive", "lane", "court", "place", "plaza", "highway", "parkway", "trail", "broadway",
    "st", "rd", "ave", "blvd", "dr", "ln", "way", "ct", "pl", "pi", "hwy", "pkwy", "cir", "circle", "oval", "loop", "pte", "vis", "vista",
]
AFTER_BROADWAY = ["st", "street", "rd", "road", "ave", "avenue", "blvd", "boulevard", "dr", "drive", "ln", "lane", "way", "ct", "court", "pl", "place", "pi", "plaza", "hwy", "highway", "pkwy", "parkway", "trail"]
DIRECTIONS_AFTER = ["south", "north", "east", "west", "s", "n", "e", "w", "nw", "ne", "sw", "se"]
DIRECTIONS_BEFORE = [*DIRECTIONS_AFTER, "northeast", "northwest", "southeast", "southwest"]
DIRECTED_CITIES = [
    "south bend", "south haven", "south lake tahoe", "north bend", "north brunswick", "north hollywood", "north bergen", "north haven", "north highlands", "north metro", "north fort myers",
    "west berlin", "west covina", "west hollywood", "west palm beach", "west trenton", "east hartford", "east orange", "east berlin", "east stroudsburg",
]
NUMBERS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth"]
UNITS = ["apt", "suite", "ste", "unit", "room", "rm", "lbl", "floor", "fl", "ph", "lot"]
UNITS_BY_NUMBER = ["floor", "fl", "ste", "apt", "suite"]
LONG_CITIES = ["el dorado hills", "new york city", "salt lake city"]
CITY_END = [
    "city", "county", "country", "valley", "beach", "park", "springs", "falls", "grove", "lake", "hills", "angeles", "diego", "francisco", "jose", "antonio", "bernardino", "mateo", "rafael", "barbara",
    "clara", "ana", "monica", "rosa", "spring", "cynwyd", "rouge", "trenton", "orange", "berlin", "covina", "worth", "lauderdale", "myers", "wayne", "green", "arrow", "pass", "breeze", "plains",
    "land", "york", "rapids", "moines", "vista", "mesa", "paso", "prairie", "vegas", "gatos", "alto", "pines", "linda", "heigh", "chase", "creek", "orchard", "twp", "aire", "river", "harbor", "sound",
    "allen", "station", "heights", "village", "island",
]
NOT_ANY = r"\bnot\s+applicable\b|\bn[.]a[.](?!\w)|\bna\b"
BOX = r"\b(?:p[.]?\s*o[.]?\s*)?box(?:\s+\w+)?\b"


def one_of(words: list[str]) -> str:
    return "(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + ")"


STREET_END = rf"\b{one_of(STREETS)}(?:[.]|\b)"
UNIT = rf"(?:\b{one_of(UNITS)}\b[.]?|#)\s*\w+"
GAP = r"(?:[,\s?]+)?"
#: What may follow a street's end and still belong to the address, each once and in this order.
DIRECTION, HOUSE_NUMBER = rf"(?:{GAP}\b{one_of(DIRECTIONS_AFTER)}\b)?", rf"(?:{GAP}\b\d+\b)?"
STOREY = rf"(?:{GAP}\b(?:{one_of(ORDINALS)}|{one_of(NUMBERS)}|\d+(?:st|nd|rd|th)?)\s+{one_of(UNITS_BY_NUMBER)}\b)?"
ROOM = rf"(?:{GAP}{UNIT})?"
LEADING = "^[.,?\\s]+"
NUMBERED = "([^ ]*[0-9].*)$"


def around(c: Column, pattern: str, group: int) -> Column:
    """What stands before (1), in (2) or after (3) the first match of a pattern, in any case; empty without one."""
    return F.regexp_extract(c, f"(?siU)^(.*?)({pattern})(.*)$", group)


def split_address(df: DataFrame, block: str, name: str = "split") -> DataFrame:
    """df with struct(name, address, city) of a block of these three: the first rule that fits counts.

    In order: a mark for none; a box number; the end of a street behind the first number, with a direction, a number, a
    storey and a unit that follow; a unit; a repeated phrase at the end; a last word that stood before; the first number
    (cities of two and three words by their last); and the final two words. Steps are columns of their own, so that none
    is worked out twice. A null or blank block has three empty parts.
    """
    b, words, none = F.col("_b"), F.col("_w"), F.lit("")
    plain = lambda w: F.lower(F.regexp_replace(w, "[,.]+$", ""))
    part = lambda *three: F.struct(*(F.trim(x).alias(n) for n, x in zip(("name", "address", "city"), three)))
    split_at = lambda c: F.filter(F.split(F.trim(c), " "), lambda w: w != "")
    text = lambda xs, at, size: F.array_join(F.slice(xs, F.greatest(at, F.lit(1)), F.greatest(size, F.lit(0))), " ")
    df = df.withColumn("_b", F.trim(F.regexp_replace(F.coalesce(block, none), r"(?U)\s+", " ")))
    df = df.withColumns({"_w": split_at(b), "_digits": F.regexp_extract(b, "^[^0-9]*([0-9].*)$", 1), "_number": F.regexp_extract(b, "^(?:[^ 0-9]+ )*" + NUMBERED, 1)})
    df = df.withColumn("_from", F.when(F.col("_digits") != "", F.col("_digits")).otherwise(b))
    for n, column, pattern in (("_none", "_b", NOT_ANY), ("_box", "_b", BOX), ("_street", "_from", STREET_END), ("_unit", "_b", UNIT)):
        df = df.withColumns({f"{n}{g}": around(F.col(column), pattern, g) for g in (1, 2, 3)})
    col = lambda n, g: F.col(f"{n}{g}")

    # A street: what comes after its end, step by step.
    more = F.when(F.lower(col("_street", 2)) == "broadway", F.regexp_extract(col("_street", 3), f"(?iU)^{GAP}\\b(?:{one_of(AFTER_BROADWAY)}[.]|{one_of(AFTER_BROADWAY)})\\b", 0)).otherwise(none)
    df = df.withColumn("_more", more).withColumn("_post", F.expr("substring(_street3, length(_more) + 1)"))
    rest = HOUSE_NUMBER + STOREY + ROOM
    directed = F.lower(F.trim(F.regexp_replace("_post", r"(?U)^\s+", ""))).rlike(f"^{one_of(DIRECTED_CITIES)}")
    df = df.withColumn("_tail", F.when(directed, F.regexp_extract("_post", f"(?iU)^{rest}", 0)).otherwise(F.regexp_extract("_post", f"(?iU)^{DIRECTION}{rest}", 0)))
    before_street = F.concat(F.expr("left(_b, length(_b) - length(_from))"), col("_street", 1))
    df = df.withColumn("_pre", split_at(before_street)).withColumns({
        "_end": F.concat(col("_street", 2), F.col("_more"), F.col("_tail")), "_city": F.regexp_replace(F.expr("substring(_post, length(_tail) + 1)"), LEADING, ""),
        "_first": F.expr("coalesce(nullif(array_position(transform(_pre, w -> w rlike '[0-9]'), true), 0), 0)").cast("int"),
    })
    pre, n_pre = F.col("_pre"), F.size("_pre")
    marked = (n_pre >= 2) & plain(F.try_element_at(pre, F.lit(-2))).isin([*DIRECTIONS_BEFORE, *NUMBERS])
    at = F.when(F.col("_first") > 0, F.col("_first")).when(marked, n_pre - 1).otherwise(F.greatest(n_pre, F.lit(1)))
    by_street = part(text(pre, F.lit(1), at - 1), F.concat_ws(" ", text(pre, at, n_pre - at + 1), F.col("_end")), F.col("_city"))

    # A box or unit: it and what stands before it from the first word with a number on.
    def by_mark(n: str, city: Column) -> Column:
        house = F.regexp_extract(F.trim(col(n, 1)), "^(?:[^ 0-9]+ )*" + NUMBERED, 1)
        lead = F.when(house == "", col(n, 1)).otherwise(F.expr(f"left(trim({n}1), length(trim({n}1)) - length(regexp_extract(trim({n}1), '^(?:[^ 0-9]+ )*{NUMBERED}', 1)))"))
        return part(lead, F.concat_ws(" ", F.nullif(house, none), col(n, 2)), city)

    n, clean = F.size(words), F.transform(words, plain)
    df = df.withColumn("_clean", clean)
    df = df.withColumns({
        "_twice": F.expr("coalesce(try_element_at(filter(if(size(_w) < 2, array(), reverse(sequence(1, greatest(1, size(_w) div 2)))), l -> slice(_clean, size(_w) - 2 * l + 1, l) = slice(_clean, size(_w) - l + 1, l)), 1), 0)"),
        "_again": F.array_position("_clean", F.try_element_at("_clean", F.lit(-1))).cast("int"), "_house": split_at(F.col("_number")),
    })
    twice, again, house, last = F.col("_twice"), F.col("_again"), F.col("_house"), F.try_element_at(words, F.lit(-1))
    k = F.size(house)
    cut = F.when((k >= 3) & F.regexp_replace(F.lower(text(house, k - 2, F.lit(3))), "[,.]+$", "").isin(LONG_CITIES), 3).when((k >= 3) & plain(last).isin(CITY_END), 2).otherwise(1)
    by_number = part(F.expr("left(_b, length(_b) - length(_number))"), text(house, F.lit(1), k - cut), text(house, k - cut + 1, cut))
    split = (
        F.when(n == 0, part(none, none, none))
        .when(col("_none", 2) != "", part(*(col("_none", g) for g in (1, 2, 3))))
        .when(col("_box", 2) != "", by_mark("_box", col("_box", 3)))
        .when(col("_street", 2) != "", by_street)
        .when(col("_unit", 2) != "", by_mark("_unit", F.regexp_replace(col("_unit", 3), LEADING, "")))
        .when(twice > 0, part(text(words, F.lit(1), n - 2 * twice), text(words, n - 2 * twice + 1, twice), text(words, n - twice + 1, twice)))
        .when((n >= 3) & (again < n), part(text(words, F.lit(1), again - 1), text(words, again, n - again), last))
        .when(F.col("_number") != "", by_number)
        .when(n >= 3, part(text(words, F.lit(1), n - 2), F.try_element_at(words, F.lit(-2)), last))
        .when(n == 2, part(F.get(words, F.lit(0)), last, none))
        .otherwise(part(b, none, none))
    )
    steps = ["_b", "_w", "_digits", "_number", "_from", "_more", "_post", "_tail", "_pre", "_end", "_city", "_first", "_clean", "_twice", "_again", "_house", *(f"{x}{g}" for x in ("_none", "_box", "_street", "_unit") for g in (1, 2, 3))]
    return df.withColumn(name, split).drop(*steps)


def split_holder(df: DataFrame, block: str, prefix: str = "") -> DataFrame:
    """df with name, address, city, state, zip, phone: phone, then zip, then the first known state come out first."""
    phone, zip_, code = (F.col(f"{prefix}{c}") for c in ("phone", "zip", "state"))
    df = df.withColumn("_rest", F.coalesce(block, F.lit("")))
    df = df.withColumn(f"{prefix}phone", first(F.col("_rest"), PHONE)).withColumn("_rest", without(F.col("_rest"), phone))
    df = df.withColumn(f"{prefix}zip", first(F.col("_rest"), ZIP)).withColumn("_rest", without(F.col("_rest"), zip_))
    df = df.withColumn(f"{prefix}state", state(F.col("_rest")))
    df = split_address(df.withColumn("_rest", without_word(F.col("_rest"), code)), "_rest", "_split")
    return df.withColumns({f"{prefix}{c}": F.col(f"_split.{c}") for c in ("name", "address", "city")}).drop("_rest", "_split")
