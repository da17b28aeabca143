"""Format-preserving pseudonyms for personal data.

A value is found by its form and checked (check digits, calendar, number ranges), read as a
number of a finite range, permuted in that range by a keyed Feistel network, and written back in
the form it was found in. The permutation depends on the kind, the key and the value only: equal values
get equal pseudonyms in all documents, different values different ones, and who has the key can
undo it. Pseudonyms pass the same checks as the values they stand for.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import hmac
import re
import string
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from pricemill.llm.columns import free

ROUNDS = 10
KINDS = ["email", "iban", "card", "phone", "ssn", "ip", "date"]


def _round(key: bytes, tweak: bytes, number: int, half: int, bits: int) -> int:
    digest = hmac.digest(key, b"%s|%d|%d|%x" % (tweak, bits, number, half), hashlib.sha256)
    return int.from_bytes(digest, "big")


@lru_cache(maxsize=1 << 16)
def permute(value: int, size: int, key: bytes, tweak: bytes, undo: bool = False) -> int:
    """A keyed permutation of ``range(size)``: a balanced Feistel network over the next even number of
    bits, repeated until the result lies in the range again."""
    if size < 2:
        return value
    bits = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << bits) - 1
    # a round gives as many digest bits as a half needs; wider halves are extended by more digests
    wide = lambda number, half: sum(_round(key, tweak, number + (i << 8), half, bits) << (256 * i) for i in range(bits // 256 + 1)) & mask
    while True:
        left, right = value >> bits, value & mask
        for number in reversed(range(ROUNDS)) if undo else range(ROUNDS):
            if undo:
                left, right = right ^ wide(number, left), left
            else:
                left, right = right, left ^ wide(number, right)
        value = left << bits | right
        if value < size:
            return value


def _digits(text: str) -> str:
    return re.sub(r"\D", "", text)


def _refill(form: str, digits: str) -> str:
    """Put digits in the places of the digits of ``form``."""
    following = iter(digits)
    return "".join(next(following) if c.isdigit() else c for c in form)


def luhn(payload: str) -> str:
    """The check digit of a card number without it."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _mod97(country: str, account: str) -> str:
    spelled = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(spelled) % 97:02d}"


Step = Callable[[int, int, bytes], int]
ALPHABETS = [string.ascii_lowercase, string.ascii_uppercase, string.digits]


def _letters(text: str, step: Step, tweak: bytes) -> str:
    """Letters become letters of the same case, digits digits, all as one number; the rest stays."""
    alphabets = [next((a for a in ALPHABETS if c in a), None) for c in text]
    value, size = 0, 1
    for c, a in zip(text, alphabets, strict=True):
        if a:
            value, size = value * len(a) + a.index(c), size * len(a)
    value = step(value, size, tweak + b":" + "".join("-" if a is None else a[0] for a in alphabets).encode())
    out = []
    for c, a in zip(reversed(text), reversed(alphabets), strict=True):
        if a:
            value, place = divmod(value, len(a))
            c = a[place]
        out.append(c)
    return "".join(reversed(out))


def _email(text: str, step: Step) -> str | None:
    body, dot, top = text.rpartition(".")
    return _letters(body, step, b"email") + dot + top


def _iban(text: str, step: Step) -> str | None:
    country, check, account = text[:2], text[2:4], text[4:]
    if _mod97(country, account) != check:
        return None
    account = _letters(account, step, b"iban:" + country.encode())
    return country + _mod97(country, account) + account


def _card(text: str, step: Step) -> str | None:
    digits = _digits(text)
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    payload = f"{step(int(digits[:-1]), 10 ** (len(digits) - 1), b'card'):0{len(digits) - 1}d}"
    return _refill(text, payload + luhn(payload))


def _phone(text: str, step: Step) -> str | None:
    digits = _digits(text)
    code = len(_digits(re.match(r"(\+\d{1,3}(?=\D)|)", text).group())) if text.startswith("+") else 0
    own = digits[code:]
    if not 7 <= len(own) <= 15 or len(digits) > 15:
        return None
    return _refill(text, digits[:code] + f"{step(int(own), 10 ** len(own), b'phone'):0{len(own)}d}")


def _ssn(text: str, step: Step) -> str | None:
    area, group, serial = (int(p) for p in text.split("-"))
    areas = [a for a in range(1, 900) if a != 666]
    if area not in areas or not group or not serial:
        return None
    value = step((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999, b"ssn")
    rest, serial = divmod(value, 9999)
    area, group = divmod(rest, 99)
    return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(text: str, step: Step) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
        return None
    value = step(int.from_bytes(bytes(parts), "big"), 1 << 32, b"ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


@lru_cache(maxsize=64)
def _days(century: int, late: bool) -> list[int]:
    """The days of a century, as ordinals: those after the 12th of their month, or the others."""
    first = datetime.date(max(century, 1), 1, 1).toordinal()
    last = datetime.date(century + 99, 12, 31).toordinal()
    return [day for day in range(first, last + 1) if (datetime.date.fromordinal(day).day > 12) == late]


def _date(text: str, step: Step) -> str | None:
    """A date stays in its century and on its side of the 12th. A text that can only be read month first
    (its day is after the 12th) so becomes another such text, and every pseudonym is read in the order of
    its value; equal dates get equal pseudonyms in whatever order they are written."""
    separator = re.search(r"\D", text).group()
    parts = text.split(separator)
    orders = ["ymd"] if len(parts[0]) == 4 else ["dmy", "mdy"]
    for order in orders:
        year, month, day = (int(parts[order.index(c)]) for c in "ymd")
        if year and 1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1]:
            break
    else:
        return None
    century, late = year - year % 100, day > 12
    days = _days(century, late)
    place = bisect_left(days, datetime.date(year, month, day).toordinal())
    new = datetime.date.fromordinal(days[step(place, len(days), b"date:%d:%d" % (century, late))])
    fields = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
    return separator.join(fields[c] for c in order)


# Fixed forms of the values; each is checked by its function afterwards. Earlier kinds go first.
FORMS: list[tuple[str, re.Pattern[str], Callable[[str, Step], str | None]]] = [
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"), _email),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"), _iban),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"), _card),
    ("phone", re.compile(r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
                         r"|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"
                         r"|(?<![0-9A-Za-z.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9.-]*[0-9])"), _phone),
    ("ssn", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"), _ssn),
    ("ip", re.compile(r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"), _ip),
    ("date", re.compile(r"(?<![0-9A-Za-z./-])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![0-9A-Za-z]|[-/.][0-9])"), _date),
]
MAY = re.compile("[0-9@]")


def pseudonymize(text: str, key: bytes, undo: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of the values found in ``text``."""
    if not MAY.search(text):
        return text, []
    step = lambda value, size, tweak: permute(value, size, key, tweak, undo)
    found: list[tuple[int, int, str, str]] = []
    for kind, form, change in FORMS:
        if kind == "email" and "@" not in text:
            continue
        before = sorted(found)  # spans of earlier kinds, apart from each other
        for match in form.finditer(text):
            start, end = match.span()
            at = bisect_left(before, (start,))
            if (at < len(before) and before[at][0] < end) or (at and before[at - 1][1] > start):
                continue
            new = change(match.group(), step)
            if new is not None:
                found.append((start, end, kind, new))
    found.sort()
    parts, at = [], 0
    for start, end, _, new in found:
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]]), [(kind, start, end) for start, end, kind, _ in found]


def _rewrite(key: bytes, text_at: int, undo: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for value in batch.column(text_at).to_pylist():
                new, found = (None, []) if value is None else pseudonymize(value, key, undo)
                texts.append(new)
                counts.append([sum(k == kind for k, _, _ in found) for kind in KINDS])
            columns = [pa.array(texts, pa.string()) if i == text_at else c for i, c in enumerate(batch.columns)]
            made = [pa.array([c[i] for c in counts], pa.int32()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=[*batch.schema.names, *[f"n_{k}" for k in KINDS]])

    return run


def pseudonymize_texts(docs: DataFrame, key: bytes, text: str = "text", undo: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in the text and a column ``n_<kind>`` for each kind of value found.

    ``key`` is the secret of the permutations; ``undo`` turns pseudonyms back. A null text stays
    null. Where forms overlap the kind listed first wins. Forms that fail their check (a card number
    with a wrong check digit, the 31st of June) are left as they are.
    """
    docs = free(docs, *[f"n_{k}" for k in KINDS])
    fields = [T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in docs.schema.fields]
    made = [T.StructField(f"n_{k}", T.IntegerType()) for k in KINDS]
    return docs.mapInArrow(_rewrite(key, docs.columns.index(text), undo), T.StructType([*fields, *made]))
