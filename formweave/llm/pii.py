"""Format-preserving pseudonyms: validated personal values are permuted by a keyed Feistel network within their format."""

from __future__ import annotations

import hashlib
import ipaddress
import re
import secrets
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import load, pieces

ROUNDS = 10
KINDS = ("card", "phone", "ssn", "iban", "ip", "ipv6", "date", "email", "secret")
#: Setting of the session that holds the key. Spark hides settings of such a name in its pages and logs.
KEY_SETTING = "spark.formweave.secret"


class Permutation:
    """Keyed bijections of range(n): a balanced Feistel network on enough bits, walked until the result is below n."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def __call__(self, value: int, n: int, label: str, valid: Callable[[int], bool] = lambda v: True) -> int:
        """The image of value; walks on while the image is not valid, so valid values permute among themselves."""
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        width = (half + 7) // 8
        while True:
            left, right = value >> half, value & mask
            for i in range(ROUNDS):
                h = hashlib.blake2b(right.to_bytes(width, "little"), key=self.key, digest_size=max(8, width), person=bytes([i]) + label.encode()[:15])
                left, right = right, left ^ (int.from_bytes(h.digest(), "little") & mask)
            value = left << half | right
            if value < n and valid(value):
                return value


def luhn_digit(payload: str) -> str:
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(payload))))
    return str(-total % 10)


def fill(template: str, digits: str) -> str:
    """template with its digits replaced in turn."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in template)


def only_digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def card(s: str, permute: Permutation) -> str | None:
    d = only_digits(s)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    n = len(d) - 1
    ok = lambda v: len({*(t := str(v).zfill(n)), luhn_digit(t)}) > 1
    p = str(permute(int(d[:-1]), 10**n, f"card{n}", ok)).zfill(n)
    return fill(s, p + luhn_digit(p))


#: Calling codes of two digits; 1 and 7 are the only ones of one digit, all others have three.
TWO_DIGIT_CODES = (
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
    "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)


def phone(s: str, permute: Permutation) -> str | None:
    """Ten digits of the North American plan (area and exchange begin with 2 to 9), with or without +1; or +, another
    calling code, which stays, and a national number, which keeps its length and whether it begins with zero."""
    d = only_digits(s)
    if s[0] == "+" and d[0] != "1":
        code = d[:1] if d[0] == "7" else d[:2] if d[:2] in TWO_DIGIT_CODES else d[:3]
        own = d[len(code) :]
        if not 8 <= len(d) <= 15 or len(own) < 5 or d[0] == "0":
            return None
        n, zero = len(own), own[0] == "0"
        ok = lambda v: (str(v).zfill(n)[0] == "0") == zero
        return fill(s, code + str(permute(int(own), 10**n, f"tel{code}-{n}-{zero:d}", ok)).zfill(n))
    lead = d[:-10]
    ok = lambda v: "2" <= (t := str(v).zfill(10))[0] and "2" <= t[3]
    if len(d) < 10 or lead not in ("", "1") or not ok(int(d[-10:])):
        return None
    return fill(s, lead + str(permute(int(d[-10:]), 10**10, "phone", ok)).zfill(10))


def ssn(s: str, permute: Permutation) -> str | None:
    def ok(v: int) -> bool:
        t = str(v).zfill(9)
        return t[:3] not in ("000", "666") and t[0] != "9" and t[3:5] != "00" and t[5:] != "0000"

    v = int(only_digits(s))
    return fill(s, str(permute(v, 10**9, "ssn", ok)).zfill(9)) if ok(v) else None


def iban(s: str, permute: Permutation) -> str | None:
    """Country and length stay; letters and digits of the account permute within their kinds, check digits follow."""
    compact = s.replace(" ", "")
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    if not 15 <= len(compact) <= 34 or number(compact[4:] + compact[:4]) % 97 != 1:
        return None
    body = mixed(compact[4:], permute, "iban" + compact[:2])
    new = compact[:2] + f"{98 - number(body + compact[:2] + '00') % 97:02d}" + body
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in s)


def ip(s: str, permute: Permutation) -> str | None:
    parts = [int(x) for x in s.split(".")]
    if max(parts) > 255:
        return None
    v = permute(sum(x << 24 - 8 * i for i, x in enumerate(parts)), 1 << 32, "ip")
    return ".".join(str(v >> k & 255) for k in (24, 16, 8, 0))


def ipv6(s: str, permute: Permutation) -> str | None:
    """Digits and letters of an address of four groups or more permute within their kinds."""
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return None
    return mixed(s, permute, "ipv6", HEX) if len([g for g in s.split(":") if g]) >= 4 else None


FIRST_YEAR, YEARS = 1900, 200
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Short forms; that of May is its name and counts as such.
SHORT = tuple(m[:3] for m in MONTHS if m != "may")


def is_day(y: int, m: int, d: int) -> bool:
    try:
        return bool(date(y, m, d))
    except ValueError:
        return False


def day(s: str, permute: Permutation) -> str | None:
    """A day of the years 1900 to 2099, which permutes with all days that the same format can write.

    Formats: year, month, day; day and month, or month and day, before the year; and English months by name or short
    name. Numbers keep their widths. Days before months and months before days are one format, as the text alone
    does not tell them apart: an image is a day in one of the two orders. Marks between the parts are not of the format.
    """
    if re.search("[A-Za-z]", s):
        return named_day(s, permute)
    a, mark, b, _, c = re.fullmatch(r"([0-9]+)([-/.])([0-9]+)([-/.])([0-9]+)", s).groups()
    first = len(a) == 4
    y, p, q = (a, b, c) if first else (c, a, b)
    size = [9 if len(x) == 1 else 31 for x in (p, q)]

    def parts(v: int) -> tuple[int, int, int]:
        v, j = divmod(v, size[1])
        v, i = divmod(v, size[0])
        return FIRST_YEAR + v, i + 1, j + 1

    ok = lambda v: is_day(*(x := parts(v))) or (not first and is_day(x[0], x[2], x[1]))
    y, i, j = int(y) - FIRST_YEAR, int(p) - 1, int(q) - 1
    if not (0 <= y < YEARS and 0 <= i < size[0] and 0 <= j < size[1]) or not ok(v := (y * size[0] + i) * size[1] + j):
        return None
    y, i, j = parts(permute(v, YEARS * size[0] * size[1], f"day{first:d}{len(p)}{len(q)}", ok))
    i, j = str(i).zfill(len(p)), str(j).zfill(len(q))
    return mark.join((str(y), i, j) if first else (i, j, str(y)))


def named_day(s: str, permute: Permutation) -> str | None:
    name = re.search("[A-Za-z]+", s)[0]
    names = SHORT if name.lower() in SHORT else MONTHS
    number, year = re.findall("[0-9]+", s)
    size = 9 if len(number) == 1 else 31

    def parts(v: int) -> tuple[int, int, int]:
        v, j = divmod(v, size)
        v, i = divmod(v, len(names))
        return FIRST_YEAR + v, i, j + 1

    month = lambda i: MONTHS.index(names[i]) + 1 if names is MONTHS else next(k for k, m in enumerate(MONTHS, 1) if m[:3] == names[i])
    ok = lambda v: is_day((x := parts(v))[0], month(x[1]), x[2])
    y, i, j = int(year) - FIRST_YEAR, names.index(name.lower()), int(number) - 1
    if not (0 <= y < YEARS and 0 <= j < size) or not ok(v := (y * len(names) + i) * size + j):
        return None
    y, i, j = parts(permute(v, YEARS * len(names) * size, f"month{len(names)}{len(number)}", ok))
    put = names[i].upper() if name.isupper() else names[i].title() if name[0].isupper() else names[i]
    new = {name: put, number: str(j).zfill(len(number)), year: str(y)}
    return re.sub("[0-9]+|[A-Za-z]+", lambda m: new[m[0]], s)


CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
HEX = ("0123456789", "abcdef", "ABCDEF")


def mixed(s: str, permute: Permutation, label: str, classes: tuple[str, ...] = CLASSES) -> str:
    """All values of the same shape (digit, small, capital letter or other character at each place) permute."""
    where = [next((c for c in classes if x in c), None) for x in s]
    value, n = 0, 1
    for x, c in zip(s, where):
        if c:
            value, n = value * len(c) + c.index(x), n * len(c)
    if n == 1:
        return s
    shape = "".join("-" if c is None else "0aA"[classes.index(c)] for c in where)
    value = permute(value, n, label[:7] + hashlib.blake2b(shape.encode(), digest_size=4).hexdigest())
    out = []
    for x, c in zip(reversed(s), reversed(where)):
        if c:
            value, k = divmod(value, len(c))
        out.append(c[k] if c else x)
    return "".join(reversed(out))


def email(s: str, permute: Permutation) -> str | None:
    name, _, domain = s.rpartition("@")
    return mixed(name, permute, "email") + "@" + domain


def secret(s: str, permute: Permutation) -> str | None:
    """An access key, or a value with a digit after the word for it."""
    head = re.match(r"AKIA|[A-Za-z_]+ ?[=:] ?\"?", s)[0]
    if not re.search("[0-9]", s[len(head) :]):
        return None
    return head + mixed(s[len(head) :], permute, "secret")


MAKE = {"card": card, "phone": phone, "ssn": ssn, "iban": iban, "ip": ip, "ipv6": ipv6, "date": day, "email": email, "secret": secret}
NAMED = "(?:" + "|".join(f"{x}{m[1:]}|{m.upper()}" for m in (*MONTHS, *SHORT) for x in [f"[{m[0].upper()}{m[0]}]"]) + ")"
FIND = re.compile(
    (
    r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9]))"
    r"|(?P<secret>(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:password|passwd|secret|token|api_key) ?[=:] ?\"?[A-Za-z0-9+/_\-]{8,128})"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z])(?!\.[0-9]))"
    r"|(?P<date>(?<![0-9A-Za-z./\-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})(?![0-9A-SU-Za-z])(?!T(?![0-9]{2}:?[0-9]{2}))|(?<![0-9A-Za-z])[0-9]{1,2} MONTH,? [0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])MONTH [0-9]{1,2},? [0-9]{4}(?![0-9A-Za-z]))"
    r"|(?P<ipv6>(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}::?){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:]))"
    r"|(?P<card>(?<![0-9A-Za-z])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9A-Za-z]))"
    r"|(?P<phone>(?<![0-9A-Za-z])(?:\+?1[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\+1[ .\-]?[0-9]{10}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\+[2-9][0-9]{0,2}(?:[ .\-]?\(?[0-9]{1,5}\)?){2,6}(?![0-9A-Za-z]))"
    r"|(?P<ssn>(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z\-]))"
    ).replace("MONTH", NAMED)
)
MAY_HOLD = re.compile("[0-9@]")
#: The alternatives of FIND, each by itself.
EACH = {re.match(r"\(\?P<(\w+)>", part)[1]: re.compile(part) for part in re.split(r"\|(?=\(\?P<)", FIND.pattern)}
#: No card is written in groups like a phone number's, so the phone comes first.
ORDER = ("email", "secret", "iban", "ip", "ipv6", "date", "phone", "card", "ssn")
#: Kinds that take in what stands beside them, where a value can also end before the end of the match.
SHORTER = {"card": re.compile("(?<=[0-9])(?=[ \\-])"), "iban": re.compile("(?<=[0-9A-Z])(?= )")}


def pseudonymiser(key: bytes) -> Callable[[str], tuple[str, list[str]]]:
    """A function that gives a text with its values replaced, and the kinds of these in order."""
    permute = Permutation(key)

    @lru_cache(1 << 16)
    def new(kind: str, s: str) -> str | None:
        return MAKE[kind](s, permute)

    def best(text: str, start: int) -> tuple[str, int, str] | None:
        """Kind, end and pseudonym of the first valid value at start: kinds in ORDER, of each the longest."""
        for kind in ORDER:
            if m := EACH[kind].match(text, start):
                ends = [x.start() for x in SHORTER[kind].finditer(text, start, m.end())] if kind in SHORTER else []
                for end in [m.end(), *reversed(ends)]:
                    if (put := new(kind, text[start:end])) is not None:
                        return kind, end, put
        return None

    def run(text: str) -> tuple[str, list[str]]:
        if not MAY_HOLD.search(text):
            return text, []
        kinds, out, at, begin = [], [], 0, 0
        while m := FIND.search(text, at):
            kind, end, put = m.lastgroup, m.end(), new(m.lastgroup, m[0])
            if put is None or kind == "card":
                kind, end, put = best(text, m.start()) or (kind, end, None)
            if put is None:  # looks alike but is not valid: another kind may begin within
                at = m.start() + 1
                continue
            kinds.append(kind)
            out += [text[begin : m.start()], put]
            at = begin = end
        return "".join([*out, text[begin:]]), kinds

    return run


def session_key(spark: SparkSession) -> str:
    """The key in the session's setting; where there is none, a random one that holds for the session."""
    if spark.conf.get(KEY_SETTING, None) is None:
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with personal values in text replaced, n_pseudonyms int and kinds array<string> (in order of place).

    Cards (Luhn), phone and social security numbers, IBANs (mod 97), IPv4 and IPv6 addresses, dates, mail addresses
    and credentials are recognised by shape and validated; others stay as they are, bare digits without any mark
    among them unless they are a card. Equal values of a format get equal pseudonyms wherever they stand, different
    values of a format different ones; who has the key can undo them. A null text stays null with no pseudonyms,
    an empty one empty. Each row is handled by itself, without a shuffle: repeated rows stay repeated, no rows give
    no rows, texts of any length are handled whole. Columns named n_pseudonyms and kinds are replaced.
    """
    docs = docs.drop("n_pseudonyms", "kinds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = pseudonymiser(key.encode())
        for batch in pieces(batches):
            done = [(None, []) if t is None else change(t) for t in batch["text"].to_pylist()]
            columns = [pa.array([t for t, _ in done], pa.string()) if n == "text" else c for n, c in zip(batch.schema.names, batch.columns)]
            count = pa.array(np.fromiter((len(k) for _, k in done), np.int32, len(done)))
            yield pa.RecordBatch.from_arrays([*columns, count, pa.array([k for _, k in done], pa.list_(pa.string()))], names=[*batch.schema.names, "n_pseudonyms", "kinds"])

    more = [T.StructField("n_pseudonyms", T.IntegerType()), T.StructField("kinds", T.ArrayType(T.StringType()))]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(load(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
