"""Format-preserving pseudonyms: a keyed Feistel permutation of validated numbers, dates and addresses in texts.

A value is read as an index into the set of all values of its format; a balanced Feistel network over the bits of
that index, repeated until the result is inside the set, permutes the set. Equal values get equal pseudonyms in all
documents, different values different ones, and the key turns them back. Lengths, separators, letter case, check
digits and calendar validity are kept, so offsets and ``n_chars`` stay right.

Found: payment cards (Luhn), IBANs (mod 97), US social security numbers, telephone numbers, IPv4 addresses, dates
between 1900 and 2099, e-mail addresses (all but the top-level domain), and credentials of known shapes.

Defined cases: a null text stays null; text without a valid value is returned as it is; of overlapping values the
one of the earlier kind in ``KINDS`` is taken. Other columns are kept by ``pseudonymised`` as they are.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

DEFAULT_KEY = b"replace with a secret of your own"
ROUNDS = 10
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
FOUND = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("length", IntegerType())]))
RESULT = StructType([StructField("text", StringType()), StructField("found", FOUND)])


# The permutation --------------------------------------------------------------------


def feistel(index: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """The image of ``index`` under a keyed permutation of range(size); ``back`` inverts it."""
    if size < 2:
        return index
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8

    def mixed(r: int, x: int) -> int:
        data = f"{tweak}|{size}|{r}|".encode() + x.to_bytes(width, "big")
        out = b""
        while len(out) < width:
            out += hashlib.blake2b(data + len(out).to_bytes(2, "big"), key=key[:64], digest_size=32).digest()
        return int.from_bytes(out[:width], "big") & mask

    while True:
        left, right = index >> half, index & mask
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ mixed(r, left), left
            else:
                left, right = right, left ^ mixed(r, right)
        index = left << half | right
        if index < size:
            return index


def permute_symbols(symbols: list[str], sets: list[str | list[str]], key: bytes, tweak: str, back: bool = False) -> list[str]:
    """Permute a sequence of symbols, each inside its own set, as one number."""
    index, size = 0, math.prod(map(len, sets))
    for s, among in zip(symbols, sets, strict=True):
        index = index * len(among) + among.index(s)
    index, out = feistel(index, size, key, tweak, back), []
    for among in reversed(sets):
        index, i = divmod(index, len(among))
        out.append(among[i])
    return out[::-1]


def permute_text(text: str, which: Callable[[int, str], str | None], key: bytes, tweak: str, back: bool = False) -> str:
    """Permute those characters of a text for which ``which(position, character)`` names a set."""
    sets = {i: among for i, c in enumerate(text) if (among := which(i, c)) and c in among}
    new = dict(zip(sets, permute_symbols([text[i] for i in sets], list(sets.values()), key, tweak, back), strict=True))
    return "".join(new.get(i, c) for i, c in enumerate(text))


def _own_class(_: int, c: str) -> str | None:
    return next((among for among in (DIGITS, LOWER, UPPER) if c in among), None)


# Kinds of values: each gives the pseudonym of a match, or None if the match is no valid value -----------------------


def luhn(digits: str) -> int:
    """Sum modulo 10 of the card check; 0 for a valid number."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10


def card(value: str, key: bytes, back: bool) -> str | None:
    places = [i for i, c in enumerate(value) if c.isdigit()]
    digits = "".join(value[i] for i in places)
    if not 13 <= len(digits) <= 19 or luhn(digits) or len(set(digits)) == 1:
        return None
    body = permute_text(digits[:-1], lambda i, c: DIGITS[1:] if i == 0 and c != "0" else DIGITS, key, "card", back)
    new = body + str(-luhn(body + "0") % 10)
    out = list(value)
    for i, c in zip(places, new, strict=True):
        out[i] = c
    return "".join(out)


def iban(value: str, key: bytes, back: bool) -> str | None:
    solid = value.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(solid) <= 34 or number(solid[4:] + solid[:4]) % 97 != 1:
        return None
    body = permute_text(solid[4:], _own_class, key, f"iban {solid[:2]}", back)
    checks = f"{98 - number(body + solid[:2] + '00') % 97:02d}"
    new = iter(solid[:2] + checks + body)
    return "".join(c if c == " " else next(new) for c in value)


def ssn(value: str, key: bytes, back: bool) -> str | None:
    areas = [f"{a:03d}" for a in range(1, 900) if a != 666]
    groups, serials = [f"{g:02d}" for g in range(1, 100)], [f"{s:04d}" for s in range(1, 10000)]
    parts = value.split("-")
    if not all(p in among for p, among in zip(parts, (areas, groups, serials), strict=True)):
        return None
    return "-".join(permute_symbols(parts, [areas, groups, serials], key, "ssn", back))


def phone(value: str, key: bytes, back: bool) -> str | None:
    places = [i for i, c in enumerate(value) if c.isdigit()]
    if not 8 <= len(places) <= 15:
        return None
    national = places[-10:] if len(places) >= 10 else places[1:]
    starts = {national[0], national[3]} if len(national) == 10 else {national[0]}
    classes = lambda i, c: None if i not in national else DIGITS if i not in starts else DIGITS[2:] if c in DIGITS[2:] else DIGITS[:2]
    return permute_text(value, classes, key, "phone", back)


def ipv4(value: str, key: bytes, back: bool) -> str | None:
    octets = [[str(i) for i in r] for r in (range(10), range(10, 100), range(100, 256))]
    parts = value.split(".")
    sets = [octets[len(p) - 1] for p in parts]
    if any(p not in among for p, among in zip(parts, sets, strict=True)):
        return None
    return ".".join(permute_symbols(parts, sets, key, "ip", back))


def date(value: str, key: bytes, back: bool) -> str | None:
    """ISO dates and day/month/year or month/day/year with one separator; the reading of an ambiguous one stays the same."""
    parts = re.split(r"[-/.]", value)
    sep = value[len(parts[0])]

    def read(parts: list[str]) -> int | None:
        a, b, c = map(int, parts)
        y, m, d = (a, b, c) if len(parts[0]) == 4 else (c, b, a) if a > 12 else (c, a, b)
        try:
            n = dt.date(y, m, d).toordinal()
        except ValueError:
            return None
        return n if FIRST_DAY <= n <= LAST_DAY else None

    def kind(parts: list[str]) -> tuple:
        return (int(parts[0]) > 12, int(parts[1]) > 12, *map(len, parts))

    def write(n: int) -> list[str]:
        day = dt.date.fromordinal(n)
        if len(parts[0]) == 4:
            new = [day.year, day.month, day.day]
        else:
            new = [day.day, day.month, day.year] if int(parts[0]) > 12 else [day.month, day.day, day.year]
        return [str(x).zfill(len(p)) for x, p in zip(new, parts, strict=True)]

    if (n := read(parts)) is None:
        return None
    while True:  # on to the next image until it is written in the same way
        n = FIRST_DAY + feistel(n - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date", back)
        new = write(n)
        if len(parts[0]) == 4 and [*map(len, new)] == [*map(len, parts)] or len(parts[0]) != 4 and kind(new) == kind(parts) and read(new) == n:
            return sep.join(new)


def email(value: str, key: bytes, back: bool) -> str | None:
    top = value.rindex(".")
    return permute_text(value, lambda i, c: None if i >= top else _own_class(i, c), key, "email", back)


PART = 256  # characters of a long credential that are permuted together, each part in its own way


def credential(value: str, key: bytes, back: bool) -> str | None:
    head = re.match(r"AKIA|[A-Za-z_-]+\s*[=:]\s*[\"']?", value).end()
    hexes = "0123456789abcdef" if re.fullmatch(r"[0-9a-f]+", value[head:]) else None
    parts = [value[a : a + PART] for a in range(head, len(value), PART)]
    return value[:head] + "".join(permute_text(p, lambda i, c: hexes or _own_class(i, c), key, f"credential{n or ''}", back) for n, p in enumerate(parts))


_LEFT, _RIGHT = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
KINDS: list[tuple[str, re.Pattern, Callable]] = [
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])"), email),
    ("credential", re.compile(_LEFT + r"AKIA[0-9A-Z]{16}" + _RIGHT), credential),
    ("credential", re.compile(_LEFT + r"(?i:password|passwd|token|secret|api_?key)\s{0,3}[=:]\s{0,3}[\"']?(?=[A-Za-z]*+[0-9])[0-9A-Za-z]{12,}+" + _RIGHT), credential),
    ("iban", re.compile(_LEFT + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _RIGHT), iban),
    ("card", re.compile(_LEFT + r"(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})" + _RIGHT), card),
    ("ssn", re.compile(_LEFT + r"\d{3}-\d{2}-\d{4}" + _RIGHT), ssn),
    ("date", re.compile(_LEFT + r"(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})" + _RIGHT), date),
    ("ip", re.compile(_LEFT + r"(?<!\d\.)\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)" + _RIGHT), ipv4),
    ("phone", re.compile(r"(?<![0-9A-Za-z_+])(?:\+1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}" + _RIGHT), phone),
    ("phone", re.compile(r"(?<![0-9A-Za-z_+])\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5}" + _RIGHT), phone),
]
_DIGIT = re.compile(r"\d")


def replace_values(text: str | None, key: bytes = DEFAULT_KEY, back: bool = False) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, length) of each in order."""
    if not text or not (_DIGIT.search(text) or "@" in text):
        return text, []
    taken: list[tuple[int, int, str, str]] = []  # sorted, and none overlaps another
    for kind, pattern, change in KINDS:
        if kind == "email" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            at = bisect_left(taken, (m.start(),))
            free = (at == 0 or taken[at - 1][1] <= m.start()) and (at == len(taken) or m.end() <= taken[at][0])
            if free and (new := change(m[0], key, back)) is not None:
                taken.insert(at, (m.start(), m.end(), kind, new))
    out, last = [], 0
    for a, b, _, new in taken:
        out += [text[last:a], new]
        last = b
    return "".join([*out, text[last:]]), [(kind, a, b - a) for a, b, kind, _ in taken]


def pseudonyms(text: Column, key: bytes = DEFAULT_KEY, back: bool = False) -> Column:
    """A struct (text, found) per whole text."""

    @F.pandas_udf(RESULT)
    def change(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([replace_values(None if x is None else x, key, back) for x in texts], columns=["text", "found"])

    return change(text)


def pseudonymised(documents: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """``documents`` with its text column replaced; all other columns and their order stay."""
    return documents.withColumn("text", pseudonyms(F.col("text"), key)["text"])
