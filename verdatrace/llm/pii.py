"""Personal data under format-preserving Feistel pseudonyms.

Candidates are found by pattern and validated (checksums, calendar, octets,
number ranges).  A valid value is an integer below the size of its format's
domain; a keyed Feistel network permutes the domain (walking the cycle until
the result is inside), and the result is written in the very format of the
original: digits for digits, letters for letters of the same case, separators
where they were, checksums made good again.  Dates written with fewer digits, or
with the month first, are permuted among those written alike, so every format
can be undone.  The permutation depends on the key
and the format alone, so equal values get equal pseudonyms in all documents,
different values different ones, and the holder of the key can undo them.

Formats: e-mail addresses (the local part), payment card numbers (Luhn), IBANs
(mod 97), IPv4 addresses, phone numbers, US social security numbers, ISO dates
and day/month/year dates.

Nulls, empties and the rest: null and empty texts stay as they are; values that
fail validation stay; a card or IBAN may be followed by further groups (an
expiry date, a CVV, a BIC), so where the longest run fails, shorter ones from
the same start are tried to the end of each group; where candidates overlap, the leftmost and there the first
listed is taken; a null key or any other column is not looked at; very long texts are
walked once; repeated rows are treated alike; extra columns pass through (one named like
``spans`` is replaced); an empty table gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from calendar import isleap, monthrange
from collections.abc import Callable, Iterator
from datetime import MAXYEAR, MINYEAR
from functools import cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame

from verdatrace.llm.common import map_arrow, texts_of, with_fields

#: The key of the queries here; give your own, from a secret store, in production.
DEMO_KEY = b"verdatrace demonstration key"
ROUNDS = 10

#: Years whose dates are permuted among themselves; those of all others are likewise.
COMMON_YEARS = range(1900, 2100)
# Country calling codes of two digits; 1 and 7 have one, all others three.
_TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


class Permutation:
    """Keyed permutations of the integers below any size, one for each domain name."""

    def __init__(self, key: bytes):
        self.key = blake2b(key, digest_size=32).digest()
        self.seen: dict[tuple[str, int, int], int] = {}

    def _round(self, domain: str, size: int, k: int, half: int, modulus: int) -> int:
        data = f"{domain}|{size}|{k}|{half}".encode()
        width = (modulus.bit_length() + 71) // 8  # 64 bits to spare, so that the remainder is even
        out = b"".join(blake2b(data + bytes([i]), key=self.key).digest() for i in range((width + 63) // 64))
        return int.from_bytes(out[:width], "big") % modulus

    def _halves(self, size: int) -> tuple[int, int]:
        a = max(2, int(size**0.5) if size < 1 << 52 else 1 << ((size.bit_length() + 1) // 2))
        return a, -(-size // a)

    def forward(self, domain: str, size: int, value: int) -> int:
        """The value's image; a domain of one value has no other."""
        known = self.seen.get((domain, size, value))
        if known is not None:
            return known
        a, b = self._halves(size)
        x = value
        while size > 1:
            left, right = x % a, x // a
            for k in range(ROUNDS):
                if k % 2:
                    right = (right + self._round(domain, size, k, left, b)) % b
                else:
                    left = (left + self._round(domain, size, k, right, a)) % a
            x = left + a * right
            if x < size:
                break
        if len(self.seen) > 100_000:
            self.seen.clear()
        self.seen[domain, size, value] = x
        return x

    def backward(self, domain: str, size: int, value: int) -> int:
        """The value whose image this is."""
        a, b = self._halves(size)
        x = value
        while size > 1:
            left, right = x % a, x // a
            for k in reversed(range(ROUNDS)):
                if k % 2:
                    right = (right - self._round(domain, size, k, left, b)) % b
                else:
                    left = (left - self._round(domain, size, k, right, a)) % a
            x = left + a * right
            if x < size:
                break
        return x


Walk = Callable[[str, int, int], int]


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    feed = iter(digits)
    return "".join(next(feed) if "0" <= c <= "9" else c for c in shape)


def luhn_digit(digits: str) -> str:
    """The check digit that makes ``digits`` and it pass the Luhn test."""
    total = sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(digits)))
    return str(-total % 10)


def _email(text: str, walk: Walk) -> str | None:
    local, _, host = text.rpartition("@")
    sizes = [26 if c.isalpha() else 10 if c.isdigit() else 1 for c in local]
    value = size = 0
    size = 1
    for c, n in zip(local, sizes, strict=True):
        value = value * n + (ord(c.lower()) - 97 if n == 26 else int(c) if n == 10 else 0)
        size *= n
    shape = "".join("a" if n == 26 else "0" if n == 10 else c for c, n in zip(local, sizes, strict=True))
    # Upper and lower case of one address stay linked.
    value = walk(f"email:{shape}", size, value)
    out = []
    for c, n in zip(reversed(local), reversed(sizes), strict=True):
        value, digit = divmod(value, n)
        out.append(c if n == 1 else str(digit) if n == 10 else chr(97 + digit).upper() if c.isupper() else chr(97 + digit))
    return "".join(reversed(out)) + "@" + host


def _card(text: str, walk: Walk) -> str | None:
    digits = re.sub(r"\D", "", text)
    if len(digits) < 13 or luhn_digit(digits[:-1]) != digits[-1] or not int(digits):
        return None
    body = f"{walk(f'card:{len(digits)}', 10 ** (len(digits) - 1), int(digits[:-1])):0{len(digits) - 1}d}"
    return _refill(text, body + luhn_digit(body))


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _iban(text: str, walk: Walk) -> str | None:
    plain = text.replace(" ", "")
    country, check, body = plain[:2], plain[2:4], plain[4:]
    if not 11 <= len(body) <= 30 or f"{_iban_check(country, body):02d}" != check:
        return None
    value, size = 0, 1
    for c in body:
        n = 10 if c.isdigit() else 26
        value, size = value * n + (int(c) if n == 10 else ord(c) - 65), size * n
    shape = "".join("0" if c.isdigit() else "A" for c in body)
    value, out = walk(f"iban:{country}{shape}", size, value), []
    for c in reversed(shape):
        value, digit = divmod(value, 10 if c == "0" else 26)
        out.append(str(digit) if c == "0" else chr(65 + digit))
    body = "".join(reversed(out))
    feed = iter(f"{country}{_iban_check(country, body):02d}{body}")
    return "".join(c if c == " " else next(feed) for c in text)


def _ip(text: str, walk: Walk) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    # Within addresses whose octets have as many digits, so that the text keeps its shape.
    low = [(0, 10, 100)[len(p) - 1] for p in parts]
    sizes = [(10, 90, 156)[len(p) - 1] for p in parts]
    value, size = 0, 1
    for p, a, n in zip(parts, low, sizes, strict=True):
        value, size = value * n + int(p) - a, size * n
    value, out = walk("ip:" + "".join(str(len(p)) for p in parts), size, value), []
    for a, n in zip(reversed(low), reversed(sizes), strict=True):
        value, digit = divmod(value, n)
        out.append(str(digit + a))
    return ".".join(reversed(out))


def _phone(text: str, walk: Walk) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 7 <= len(digits) <= 15:
        return None
    # A country code stays, whatever stands between it and the rest; so a number stays linked however it is punctuated.
    if text[0] == "+":
        size = 1 if digits[0] in "17" else 2 if digits[:2] in _TWO_DIGITS else 3
    else:
        size = len(re.sub(r"\D", "", text[: text.find("(")])) if "(" in text else 0
    code, rest = digits[:size], digits[size:]
    return _refill(text, code + f"{walk(f'phone:{len(rest)}', 10 ** len(rest), int(rest)):0{len(rest)}d}")


def _ssn(text: str, walk: Walk) -> str | None:
    area, group, serial = (int(x) for x in text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    place = area - 1 - (area > 666)  # 898 areas: 001 to 899 but 666
    value = walk("ssn", 898 * 99 * 9999, (place * 99 + group - 1) * 9999 + serial - 1)
    value, serial = divmod(value, 9999)
    place, group = divmod(value, 99)
    return f"{place + 1 + (place >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


@cache
def _years(common: bool) -> tuple[list[int], list[int]]:
    """The years of a domain, and the leap years among them."""
    years = [y for y in range(MINYEAR, MAXYEAR + 1) if (y in COMMON_YEARS) == common]
    return years, [y for y in years if isleap(y)]


@cache
def _days(first: int, second: int, month_first: bool) -> list[tuple[int, int]]:
    """Month and day of all dates of a common year that can be written with so many digits.

    Dates are read day first where that is a date, so month first are only those
    whose day is above twelve; either kind is permuted among its own.
    """
    fits = lambda value, digits: value < 10 or digits == 2
    every = [(m, d) for m in range(1, 13) for d in range(1, monthrange(2001, m)[1] + 1)]
    if month_first:
        return [(m, d) for m, d in every if d > 12 and fits(m, first) and second == 2]
    return [(m, d) for m, d in every if fits(d, first) and fits(m, second)]


def _moved(year: int, month: int, day: int, first: int, second: int, month_first: bool, walk: Walk) -> tuple[int, int, int]:
    """The date that stands for a date among those that are written alike."""
    days, (years, leaps) = _days(first, second, month_first), _years(year in COMMON_YEARS)
    # The leap days, where they can be written, come after all other dates.
    odd = leaps if (first == 2 and not month_first) or (month_first and second == 2) else []
    size = len(days) * len(years) + len(odd)
    at = len(days) * len(years) + bisect_left(odd, year) if (month, day) == (2, 29) else bisect_left(years, year) * len(days) + bisect_left(days, (month, day))
    # ISO dates and day-first ones of full width share a domain, so they stay linked.
    name = f"date:{years[0]}" + ("" if (first, second, month_first) == (2, 2, False) else f":{first}{second}{'m' if month_first else 'd'}")
    at = walk(name, size, at)
    if at >= len(days) * len(years):
        return odd[at - len(days) * len(years)], 2, 29
    return years[at // len(days)], *days[at % len(days)]


def _valid(year: int, month: int, day: int) -> bool:
    return MINYEAR <= year <= MAXYEAR and 1 <= month <= 12 and 1 <= day <= monthrange(year, month)[1]


def _iso(text: str, walk: Walk) -> str | None:
    year, month, day = (int(x) for x in text.split("-"))
    if not _valid(year, month, day):
        return None
    year, month, day = _moved(year, month, day, 2, 2, False, walk)
    return f"{year:04d}-{month:02d}-{day:02d}"


def _dmy(text: str, walk: Walk) -> str | None:
    a, b, c = re.split(r"[./]", text)
    day, month, year, month_first = int(a), int(b), int(c), False
    if not _valid(year, month, day):
        day, month, month_first = month, day, True  # month first, where only that is a date
        if not _valid(year, month, day):
            return None
    year, month, day = _moved(year, month, day, len(a), len(b), month_first, walk)
    first, second = (month, day) if month_first else (day, month)
    return f"{first:0{len(a)}d}{text[len(a)]}{second:0{len(b)}d}{text[len(a)]}{year:04d}"


#: Kinds in the order in which they are tried at a place.
KINDS: dict[str, tuple[str, Callable[[str, Walk], str | None]]] = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", _email),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    "iso_date": (r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])", _iso),
    "ip": (r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])", _ip),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _ssn),
    "card": (r"(?<![A-Za-z0-9.+-])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])", _card),
    "phone": (r"(?<![A-Za-z0-9+(-])(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![A-Za-z0-9+-])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])|(?<![A-Za-z0-9+.-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9-])", _phone),
    "dmy_date": (r"(?<![0-9./])[0-9]{1,2}(?P<sep>[./])[0-9]{1,2}(?P=sep)[0-9]{4}(?![0-9])", _dmy),
}
#: Kinds with a checksum whose groups may be followed by others that are not theirs: an expiry date, a CVV, a BIC.
GROUPED = ("iban", "card")
_MAYBE = re.compile(r"[0-9@]").search
_PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, (p, _) in KINDS.items()))


def _longest(kind: str, text: str, start: int, end: int, walk: Walk) -> tuple[int, str] | None:
    """End and pseudonym of the longest valid value from ``start``: to ``end`` or, if grouped, to the end of a group before."""
    cuts = [start + x.start() for x in re.finditer("[ -]", text[start:end])] if kind in GROUPED else []
    return next(((cut, made) for cut in (end, *reversed(cuts)) if (made := KINDS[kind][1](text[start:cut], walk)) is not None), None)


def _value(kind: str, text: str, start: int, end: int, walk: Walk) -> tuple[int, str] | None:
    """As :func:`_longest`, but a shorter run gives way to a longer one that starts at a later group within it."""
    got = _longest(kind, text, start, end, walk)
    if got is None or got[0] == end:
        return got
    later = (re.compile(KINDS[kind][0]).match(text, start + x.end()) for x in re.finditer("[ -]", text[start : got[0]]))
    others = ((m.start(), _longest(kind, text, m.start(), m.end(), walk)) for m in later if m)
    return None if any(x and x[0] - at > got[0] - start for at, x in others) else got


def pseudonymise(text: str, walk: Walk) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and the kind and place (in the original, end exclusive) of each."""
    if not _MAYBE(text):
        return text, []
    out, spans, last, at = [], [], 0, 0
    while m := _PATTERN.search(text, at):
        kind, start = m.lastgroup if m.lastgroup in KINDS else "dmy_date", m.start()
        got = _value(kind, text, start, m.end(), walk)
        if got is None:
            at = start + 1
            # Another kind may start at the same place.
            for other, (pattern, _) in list(KINDS.items())[list(KINDS).index(kind) + 1 :]:
                if (n := re.compile(pattern).match(text, start)) and (got := _value(other, text, start, n.end(), walk)) is not None:
                    kind = other
                    break
            else:
                continue
        end, made = got
        out += [text[last:start], made]
        spans.append((kind, start, end))
        last = at = end
    return "".join([*out, text[last:]]), spans


def redact(docs: DataFrame, text: str = "text", key: bytes = DEMO_KEY, spans: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; with ``spans``, a column of that name lists kinds and places."""
    docs = docs.drop(spans) if spans else docs
    place = docs.columns.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    schema = with_fields(docs, f"{spans} array<struct<kind: string, start: int, end: int>>") if spans else docs.schema
    worker: list[Permutation] = []

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not worker:
            worker.append(Permutation(key))
        column = batch.column(place)
        made = [pseudonymise(x, worker[0].forward) for x in texts_of(column)]
        new = pa.array([None if x is None else m[0] for x, m in zip(column.to_pylist(), made, strict=True)], column.type)
        columns = [*batch.columns[:place], new, *batch.columns[place + 1 :]]
        if spans:
            columns.append(pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in m[1]] for m in made], kind))
        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_arrow(docs, run, schema)
