"""Personal data replaced by format-preserving Feistel pseudonyms.

Numbers and dates are found by pattern, kept only if they validate (check digits, ranges, calendar), and permuted by a keyed
Feistel network over their own format: digits become digits, separators stay, a valid value becomes a valid value. A value
outside the format's valid set is walked further along the cycle, so the map stays one to one on that set. The key alone
fixes the map, so equal values stay linked across documents and across ways of writing them: all ways of writing a day go
through one permutation, which keeps days after the twelfth among themselves, for those tell month and day apart. Addresses
of mail keep their domain, and their letters and digits are permuted as letters and digits, ``CHUNK`` of them as one number,
each chunk with a permutation that depends on those before it, so names of any length take time in proportion.

Defined results: a null or empty text stays as it is and has no values; of overlapping matches the one that begins first is
taken, of those the kind listed first; of an account number's match that fails, the longest valid part up to a space is
taken; numbers that fail validation stay, and the search goes on from their second character; repeated rows get the same text; null ids are
kept; an empty table gives an empty result; very long texts are read whole; other columns are not read. Whoever has the key
can undo the map, so there is no default: a missing or empty key is an error.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

ROUNDS = 10
#: Days that a date may fall on, first and last.
DAYS = (date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal())
#: Letters or digits of a mail name that are permuted as one number.
CHUNK = 24


def feistel(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of 0 .. size - 1: an alternating Feistel network over a x b >= size, walked back into the range."""
    if size < 2:
        return value
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)  # left < a, right < b
        for r in range(ROUNDS):
            seed = hashlib.blake2b(b"%b|%d|%d|%d" % (tweak, size, r, right if r % 2 == 0 else left), key=key, digest_size=16).digest()
            if r % 2 == 0:
                left = (left + int.from_bytes(seed, "big")) % a
            else:
                right = (right + int.from_bytes(seed, "big")) % b
        value = left * b + right
        if value < size:
            return value


def luhn(digits: str) -> bool:
    return not sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


def _filled(shape: str, digits: str) -> str:
    """The digits of a text replaced one by one."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _walk(value: int, size: int, key: bytes, tweak: bytes, valid: Callable[[int], bool]) -> int:
    while True:
        value = feistel(value, size, key, tweak)
        if valid(value):
            return value


def card(text: str, key: bytes) -> str | None:
    """13 to 19 digits with a Luhn check digit, which follows the permuted rest."""
    d = _digits(text)
    if not 13 <= len(d) <= 19 or not luhn(d) or len(set(d)) == 1:
        return None
    body = len(d) - 1
    new = f"{_walk(int(d[:-1]), 10**body, key, b'card', lambda v: len(set(f'{v:0{body}d}')) > 1):0{body}d}"
    return _filled(text, new + next(c for c in "0123456789" if luhn(new + c)))


def phone(text: str, key: bytes) -> str | None:
    """The last ten digits; area and exchange do not begin with 0 or 1 where they did not."""
    d = _digits(text)
    if not 10 <= len(d) <= 13:
        return None
    strict = d[-10] > "1" and d[-7] > "1"
    new = _walk(int(d[-10:]), 10**10, key, b"phone" + bytes([strict]), lambda v: (f"{v:010d}"[0] > "1" and f"{v:010d}"[3] > "1") == strict)
    return _filled(text, d[:-10] + f"{new:010d}")


def social(text: str, key: bytes) -> str | None:
    """Three, two and four digits, none of them zero, the first neither 666 nor from 900."""
    ok = lambda v: (v := f"{v:09d}")[:3] not in ("000", "666") and v[0] != "9" and v[3:5] != "00" and v[5:] != "0000"
    value = int(_digits(text))
    return _filled(text, f"{_walk(value, 10**9, key, b'social', ok):09d}") if ok(value) else None


def account(text: str, key: bytes) -> str | None:
    """An account number with country and two check digits by modulus 97; letters stay."""
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _digits(plain[4:])
    if not body:
        return None
    new = f"{feistel(int(body), 10 ** len(body), key, b'account' + plain[:2].encode()):0{len(body)}d}"
    rest = _filled(plain[4:], new)
    check = f"{98 - number(rest + plain[:2] + '00') % 97:02d}"
    out = iter(plain[:2] + check + rest)
    return "".join(c if c == " " else next(out) for c in text)


def network(text: str, key: bytes) -> str | None:
    """A dotted address of four numbers up to 255; only hosts of the same kind stand for each other."""
    parts = text.split(".")
    if any(int(p) > 255 or (p[0] == "0" and p != "0") for p in parts):
        return None
    kind = lambda v: (v >> 24 in (0, 10, 127)) or v >> 24 >= 224 or v >> 20 == 0xAC1 or v >> 16 == 0xC0A8
    value = int.from_bytes(bytes(map(int, parts)), "big")
    if kind(value):
        return None  # private, loopback and reserved addresses name no one
    return ".".join(map(str, _walk(value, 1 << 32, key, b"network", lambda v: not kind(v)).to_bytes(4, "big")))


def _day(y: int, m: int, d: int) -> int | None:
    try:
        n = date(y, m, d).toordinal()
    except ValueError:
        return None
    return n if DAYS[0] <= n <= DAYS[1] else None


def calendar(text: str, key: bytes) -> str | None:
    """A day written as year-month-day or day/month/year; the order that the day allows is kept."""
    a, b, c = map(int, re.findall(r"\d+", text))
    first_year = len(re.match(r"\d+", text)[0]) == 4
    month_first = not first_year and b > 12
    n = _day(a, b, c) if first_year else _day(c, a, b) if month_first else _day(c, b, a)
    if n is None:
        return None
    late = lambda v: date.fromordinal(DAYS[0] + v).day > 12
    own = late(n - DAYS[0])
    new = date.fromordinal(DAYS[0] + _walk(n - DAYS[0], DAYS[1] - DAYS[0] + 1, key, b"day", lambda v: late(v) == own))
    year, month, day = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
    parts = (year, month, day) if first_year else (month, day, year) if month_first else (day, month, year)
    marks = re.findall(r"[^\d]", text)
    return parts[0] + marks[0] + parts[1] + marks[1] + parts[2]


def _letters(found: str, alphabet: str, key: bytes) -> str:
    """A string over an alphabet permuted chunk by chunk, each under the chunks before it."""
    out, seen, place = [], hashlib.blake2b(key=key, digest_size=16), {c: k for k, c in enumerate(alphabet)}
    for at in range(0, len(found), CHUNK):
        chunk, value = found[at : at + CHUNK], 0
        for c in chunk:
            value = value * len(alphabet) + place[c]
        value, new = feistel(value, len(alphabet) ** len(chunk), key, b"mail" + (seen.digest() if at else b"")), []
        for _ in chunk:
            value, k = divmod(value, len(alphabet))
            new.append(alphabet[k])
        out += reversed(new)
        seen.update(chunk.encode())
    return "".join(out)


def mail(text: str, key: bytes) -> str | None:
    """Letters and digits before the @, each within its own alphabet and case; a name and the domain are permuted as one."""
    name, _, domain = text.rpartition("@")
    out = name
    for alphabet in ("0123456789", "abcdefghijklmnopqrstuvwxyz"):
        it = iter(_letters("".join(c for c in out.lower() if c in alphabet), alphabet, key))
        out = "".join((next(it).upper() if c.isupper() else next(it)) if c.lower() in alphabet else c for c in out)
    return f"{out}@{domain}"


#: Kinds in the order in which they are tried at one place.
KINDS: tuple[tuple[str, str, Callable[[str, bytes], str | None]], ...] = (
    ("mail", r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", mail),
    ("account", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", account),
    ("network", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", network),
    ("calendar", r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\d/]|[.-]\d)", calendar),
    ("social", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", social),
    ("phone", r"(?<![\w+(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<!\w)\+\d{11,13}(?!\d)", phone),
    ("card", r"(?<![\w.-])(?:\d{13,19}|\d{4}(?: \d{4}){2} \d{1,7}|\d{4}(?:-\d{4}){2}-\d{1,7}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?![\w-])", card),
)
_FOUND = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern, _ in KINDS), re.ASCII)
#: A text without a run of two digits or an @ holds none of the kinds.
_HINT = re.compile(r"\d\d|@|\d[./]\d")
_BY_NAME = {name: f for name, _, f in KINDS}


def replaced(text: str, key: bytes) -> tuple[str, dict[str, int], list[tuple[str, int, int]]]:
    """The text with pseudonyms, how many values of each kind were replaced, and where they were."""
    counts: dict[str, int] = {}
    spans: list[tuple[str, int, int]] = []
    if not _HINT.search(text):
        return text, counts, spans
    out, at, m = [], 0, _FOUND.search(text)
    while m is not None:
        found, kind = m[0], m.lastgroup
        new = _BY_NAME[kind](found, key)
        while new is None and kind == "account" and " " in found:  # the pattern may have taken words after the number
            found = found.rpartition(" ")[0]
            new = account(found, key)
        if new is not None:
            out += [text[at : m.start()], new]
            at = m.start() + len(found)
            counts[kind] = counts.get(kind, 0) + 1
            spans.append((kind, m.start(), at))
        m = _FOUND.search(text, m.start() + 1 if new is None else at)
    return "".join([*out, text[at:]]), counts, spans


def _run(key: bytes, carry: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in rows for part in slices(whole, "__text")):
            done = [(t, {}, []) if t is None else replaced(t, key) for t in (v.as_py() for v in batch.column("__text"))]
            cols = [pa.array([d[0] for d in done], pa.string()), pa.array([sum(d[1].values()) for d in done], pa.int64()), *(pa.array([d[1].get(n, 0) for d in done], pa.int64()) for n in _BY_NAME)]
            cols.append(pa.array([",".join(f"{n}:{a}:{b}" for n, a, b in d[2]) for d in done], pa.string()))
            kept = batch.schema.names[:carry]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *cols], names=[*kept, "text", "n_values", *(f"n_{n}" for n in _BY_NAME), "spans"])

    return run


def pseudonymised(docs: DataFrame, key: bytes, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Carried columns with text (replaced), n_values, a count for each kind, and spans (``kind:start:end`` of the original)."""
    if not key:
        raise ValueError("pseudonyms need a key")
    rows = docs.select(*carry, F.col(text_col).cast("string").alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(_run(key, len(carry)), ", ".join([*fields, "text string, n_values long", *(f"n_{n} long" for n in _BY_NAME), "spans string"]))
