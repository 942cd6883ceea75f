"""Format-preserving pseudonyms for personal data, by a keyed Feistel network.

A value that passes its kind's check is read as a number in the domain of its format, the
number is permuted by the key, and the result is written in the same format, so equal
values get equal pseudonyms in every document and a holder of the key can go back.
"""

from __future__ import annotations

import bisect
import datetime as dt
import hashlib
import hmac
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 10
_DAYS = (dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal())
#: Characters that are permuted together, and the most of a value that is remembered.
LONGEST = 128


def permute(key: bytes, tweak: str, value: int, size: int, back: bool = False) -> int:
    """A keyed permutation of range(size); tweak separates kinds and formats.

    Feistel rounds add a keyed hash of one half to the other, over the product of two
    moduli that just holds the domain; values that fall outside it go round again.
    """
    if size <= 1:
        return value
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    width = (max(a, b).bit_length() + 7) // 8 + 8

    def mixed(r: int, x: int, modulus: int) -> int:
        said = f"{tweak}|{size}|{r}|{x}".encode()
        out = b""
        while len(out) < width:
            out += hmac.digest(key, said + b"|%d" % len(out), hashlib.sha256)
        return int.from_bytes(out[:width], "big") % modulus

    while True:
        left, right = divmod(value, b)
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if r % 2 == 0:
                left = (left + sign * mixed(r, right, a)) % a
            else:
                right = (right + sign * mixed(r, left, b)) % b
        value = left * b + right
        if value < size:
            return value


# The character classes that keep their places.
_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CLASS = {c: (s, i) for s in _CLASSES for i, c in enumerate(s)}


def permute_text(key: bytes, kind: str, text: str, back: bool = False) -> str:
    """text with its ASCII digits and letters permuted together, each within its class; other characters stay. Longer texts go by pieces of LONGEST."""
    if len(text) > LONGEST:
        return "".join(permute_text(key, f"{kind}+{a}" if a else kind, text[a : a + LONGEST], back) for a in range(0, len(text), LONGEST))
    value, size = 0, 1
    for c in text:
        if c in _CLASS:
            s, i = _CLASS[c]
            value, size = value * len(s) + i, size * len(s)
    shape = "".join("9" if c in _CLASSES[0] else "a" if c in _CLASSES[1] else "A" if c in _CLASSES[2] else c for c in text)
    value = permute(key, f"{kind}|{shape}", value, size, back)
    out = []
    for c in reversed(text):
        if c in _CLASS:
            s = _CLASS[c][0]
            value, i = divmod(value, len(s))
            c = s[i]
        out.append(c)
    return "".join(reversed(out))


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        x = int(c) * (2 if i % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return str(-total % 10)


def _fill(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def card(key: bytes, text: str, back: bool = False) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or digits[0] == "0" or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = digits[0] + permute_text(key, "card" + digits[0], digits[1:-1], back)
    return _fill(text, body + luhn_digit(body))


def cards(key: bytes, text: str, back: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, pseudonym) of the card numbers in a run of digits with single spaces or hyphens.

    Numbers grouped as on a card, or not at all, may stand anywhere between separators, and
    come first. Then stretches of up to 19 digits are read from left to right, each cut at
    its separators from the right until it is a card number. A pseudonym is drawn on while
    it turns what was tried before into a card number, so that the way back reads the same.
    """
    groups = [m.span() for m in re.finditer(r"\d+", text)]
    widths = [b - a for a, b in groups]
    tried: list[tuple[int, int]] = []
    for i in range(len(groups)):
        ends = [i + len(form) for form in _CARD_FORMS if tuple(widths[i : i + len(form)]) == form]
        tried += [(i, e) for e in ends] + ([(i, i + 1)] if 13 <= widths[i] <= 19 else [])
    i = 0
    while i < len(groups):
        e, n = i, 0
        while e < len(groups) and n + widths[e] <= 19:
            n, e = n + widths[e], e + 1
        last = e
        while n >= 13:
            tried.append((i, e))
            e -= 1
            n -= widths[e]
        i = max(last, i + 1)
    out: list[tuple[int, int, str]] = []
    failed: list[tuple[int, int]] = []
    for i, e in dict.fromkeys(tried):
        a, b = groups[i][0], groups[e - 1][1]
        if any(a < y and x < b for x, y, _ in out):
            continue
        new = card(key, text[a:b], back)
        if new is None:
            failed.append((a, b))
            continue
        near = [(x, y) for x, y in failed if a < y and x < b]
        while any(card(key, (text[:a] + new + text[b:])[x:y]) is not None for x, y in near):
            new = card(key, new, back)
        out.append((a, b, new))
    return out


def phone(key: bytes, text: str, back: bool = False) -> str | None:
    """A number with a plus sign keeps its first group; one without needs the form of an area code in brackets."""
    digits = re.sub(r"\D", "", text)
    if not 8 <= len(digits) <= 15:
        return None
    keep = re.match(r"\+\d{1,3}(?=\D)|\+\d|", text).end()
    return text[:keep] + permute_text(key, "phone" + text[:keep], text[keep:], back)


def ssn(key: bytes, text: str, back: bool = False) -> str | None:
    def valid(t: str) -> bool:
        return t[:3] not in ("000", "666") and t[0] != "9" and t[4:6] != "00" and t[7:] != "0000"

    if not valid(text):
        return None
    text = permute_text(key, "ssn", text, back)
    while not valid(text):
        text = permute_text(key, "ssn", text, back)
    return text


def iban(key: bytes, text: str, back: bool = False) -> str | None:
    flat = text.replace(" ", "")
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = permute_text(key, "iban" + flat[:2], flat[4:], back)
    flat = flat[:2] + f"{98 - number(body + flat[:2] + '00') % 97:02d}" + body
    it = iter(flat)
    return "".join(c if c == " " else next(it) for c in text)


def ipv4(key: bytes, text: str, back: bool = False) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = permute(key, "ipv4", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def email(key: bytes, text: str, back: bool = False) -> str | None:
    local, _, domain = text.rpartition("@")
    return f"{permute_text(key, 'email', local, back)}@{domain}"


def secret(key: bytes, text: str, back: bool = False) -> str | None:
    return permute_text(key, "secret", text, back)


def date(key: bytes, text: str, back: bool = False) -> str | None:
    """A calendar date of 1900 to 2099. Day and month written either way round are one format each: day first unless that is no date."""
    mark = re.search(r"\D", text)[0]
    p = list(map(int, text.split(mark)))
    for order in ((0, 1, 2),) if len(text) - len(text.lstrip("0123456789")) == 4 else ((2, 1, 0), (2, 0, 1)):
        try:
            day = dt.date(*(p[i] for i in order))
        except ValueError:
            continue
        if not _DAYS[0] <= day.toordinal() < _DAYS[1]:
            return None
        # Only dates that read back in the same order belong to a format.
        size, x = _DAYS[1] - _DAYS[0], day.toordinal() - _DAYS[0]
        while True:
            x = permute(key, f"date{order}", x, size, back)
            new = dt.date.fromordinal(x + _DAYS[0])
            if order != (2, 0, 1) or new.day > 12:
                break
        widths = [len(s) for s in text.split(mark)]
        part = {order[0]: f"{new.year:04d}", order[1]: f"{new.month:02d}", order[2]: f"{new.day:02d}"}
        return mark.join(part[i] for i in range(3)) if min(widths) > 1 else None
    return None


# What may be of a kind, before its check. The first kind that accepts a text takes it.
_NUMBER = re.compile(r"(?<![\w.@+-])[+(]?\d[\d ().:/-]{5,}\d(?!\w)")
_KINDS: tuple[tuple[str, re.Pattern, Callable], ...] = (
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])"), ssn),
    ("ipv4", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"), ipv4),
    ("phone", re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}"), phone),
)
_CARDS = re.compile(r"(?<![\d.])\d(?:[ -]?\d){12,}")
_CARD_FORMS = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4))
_DATE = re.compile(r"(?<!\d)(?<!\d[./-])(?:\d{4}([-/.])\d\d\1\d\d|\d\d([-/.])\d\d\2\d{4})(?!\d|[/-]\d)")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_SECRET = re.compile(r"(?P<head>\b(?:password|passwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)(?P<body>[A-Za-z0-9+/_-]{8,}(?:\.[A-Za-z0-9+/_-]+)*)", re.I)
_ACCESS_KEY = re.compile(r"\bAKIA(?P<body>[A-Z0-9]{16})\b")


class Pseudonyms:
    """Replaces the personal data in texts; remembers the values of a batch."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back, self.known = key, back, {}

    def _one(self, kind: str, make: Callable, value: str) -> str | None:
        if len(value) > LONGEST:
            return make(self.key, value, self.back)
        at = (kind, value)
        if at not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[at] = make(self.key, value, self.back)
        return self.known[at]

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with pseudonyms, and how many values of each kind it held."""
        found: list[tuple[int, int, str, str]] = []

        def take(a: int, b: int, kind: str, make: Callable) -> None:
            new = self._one(kind, make, text[a:b])
            if new is not None:
                found.append((a, b, kind, new))

        if "@" in text:
            at, floor = text.find("@"), 0
            while at >= 0:
                m = _EMAIL.search(text, max(floor, at - 64), min(len(text), at + 320))
                if m and m.start() < at < m.end():
                    take(*m.span(), "email", email)
                    floor = m.end()
                at = text.find("@", max(at + 1, floor))
        lower = text if len(text) < 8 else text.lower()
        if any(w in lower for w in ("passw", "secret", "token", "api")):
            for m in _SECRET.finditer(text):
                take(*m.span("body"), "secret", secret)
        if "AKIA" in text:
            for m in _ACCESS_KEY.finditer(text):
                take(*m.span("body"), "secret", secret)
        for m in _DATE.finditer(text):
            take(*m.span(), "date", date)
        for run in _NUMBER.finditer(text):
            for m in _CARDS.finditer(text, run.start(), run.end()):
                at = ("cards", m[0])
                made = self.known.get(at) or cards(self.key, m[0], self.back)
                if len(m[0]) <= LONGEST and len(self.known) <= 50_000:
                    self.known[at] = made
                found += [(m.start() + a, m.start() + b, "card", new) for a, b, new in made]
            for kind, pattern, make in _KINDS:
                for m in pattern.finditer(text, run.start(), run.end()):
                    take(*m.span(), kind, make)
        for m in _IBAN.finditer(text):
            end = m.end()
            while end > m.start() and self._one("iban", iban, text[m.start() : end]) is None:
                end = text.rfind(" ", m.start(), end)
            if end > m.start():
                take(m.start(), end, "iban", iban)
        if not found:
            return text, {}
        order = {k: i for i, k in enumerate(("email", "secret", "iban", "card", "date", "ssn", "ipv4", "phone"))}
        taken: list[tuple[int, int, str, str]] = []  # by place, none overlapping
        for f in sorted(found, key=lambda f: (order[f[2]], f[0], -f[1])):
            i = bisect.bisect(taken, f)
            if (i == 0 or taken[i - 1][1] <= f[0]) and (i == len(taken) or f[1] <= taken[i][0]):
                taken.insert(i, f)
        out, at, tally = [], 0, {}
        for a, b, kind, new in taken:
            out += [text[at:a], new]
            at = b
            tally[kind] = tally.get(kind, 0) + 1
        return "".join([*out, text[at:]]), tally


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", back: bool = False) -> DataFrame:
    """docs with personal data in whole texts replaced, and found, the number of values by kind.

    Kinds: e-mail addresses (local part), card numbers that pass the Luhn test (first digit
    kept, check digit made anew), dates of 1900 to 2099, social security numbers of valid
    ranges, IPv4 addresses, phone numbers, IBANs that pass the mod 97 test, and assigned
    secrets. Values that fail their kind's check stay. Null texts stay null with nothing
    found, as do empty ones; repeated rows stay; a column named found is replaced and all others stay.
    back=True undoes the replacement under the same key.
    """
    rest = docs.drop("found")
    schema = T.StructType([*rest.schema.fields, T.StructField("found", T.MapType(T.StringType(), T.LongType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, back)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            made = [names.replace(t) if t else (t, {}) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([m[0] for m in made], pa.string())
            found = pa.array([list(m[1].items()) for m in made], pa.map_(pa.string(), pa.int64()))
            yield pa.RecordBatch.from_arrays([*columns, found], names=[*batch.schema.names, "found"])

    return rest.mapInArrow(run, schema)


def total(found: str = "found"):
    return F.aggregate(F.map_values(found), F.lit(0).cast("long"), lambda a, b: a + b)
