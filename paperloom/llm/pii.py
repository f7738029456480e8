"""Format-preserving pseudonyms for personal data by a keyed Feistel network.

Found values are validated (check digits, octets, calendar dates, lengths) and then permuted within
their own format under a secret key: a card number becomes another number that passes the
check, a date another date in the same notation, a letter of an address another letter of its case.
The permutation depends on the key and the kind alone, so equal values stay equal in all texts
and different ones stay different, and who holds the key can reverse it.

Kinds: payment card (13 to 19 digits, Luhn), IBAN (mod 97), US social security number, telephone
number, IPv4 address, date, e-mail address, access key, secret after a ``password=`` mark.
Digits that fail their check are left alone.

Cards may stand among other digits, as a security code or a quantity. An unbroken card and one in a layout of
``LAYOUTS`` are taken at any place of a row of digits, before all others, so that the same span is found in the text
with pseudonyms; other layouts where the row begins, longest first, each ending at a separator.

Defined results: null stays null, empty stays empty; texts are worked on whole; rows repeat as
they are; an empty table gives an empty result, and further columns play no part. Of values that overlap the one of
the kind tried first counts. The key is a parameter that has no default.
"""

from __future__ import annotations

import bisect
import datetime
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
ROWS = 500
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
#: Groups of digits of cards.
LAYOUTS = {(4, 4, 4, 4), (4, 6, 5)}
_DIGIT_ROW, _DIGIT_GROUP = re.compile(r"(?<![\d-])\d(?:[ -]?\d){12,}"), re.compile(r"\d+")
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY


def _round(key: bytes, tweak: bytes, i: int, half: int, size: int) -> int:
    raw = half.to_bytes((half.bit_length() + 7) // 8 or 1, "big")
    return int.from_bytes(blake2b(raw, key=key[:64], salt=i.to_bytes(2, "big"), person=blake2b(tweak, digest_size=16).digest(), digest_size=16).digest(), "big") % size


def permute(key: bytes, tweak: bytes, value: int, size: int, back: bool = False) -> int:
    """A keyed permutation of range(size): Feistel rounds on two halves, walking until inside."""
    if size < 2:
        return value
    a = max(2, int(size**0.5))
    while a * a < size:
        a += 1
    while True:
        left, right = divmod(value, a)
        for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            if back:
                left, right = (right - _round(key, tweak, i, left, a)) % a, left
            else:
                left, right = right, (left + _round(key, tweak, i, right, a)) % a
        value = left * a + right
        if value < size:
            return value


def _digits(key: bytes, kind: str, digits: str, back: bool) -> str:
    n = len(digits)
    return str(permute(key, f"{kind}{n}".encode(), int(digits), 10**n, back)).zfill(n)


def _fill(form: str, digits: str) -> str:
    """Digits in the places of a form's digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def _only(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10


def _card(key: bytes, found: str, back: bool) -> str | None:
    d = _only(found)
    if not 13 <= len(d) <= 19 or luhn(d):
        return None
    body = _digits(key, "card", d[:-1], back)
    return _fill(found, body + str(-luhn(body + "0") % 10))


class Taken:
    """What was found in a text, in order; no two overlap."""

    def __init__(self):
        self.starts, self.rows = [], []

    def free(self, start: int, end: int) -> bool:
        i = bisect.bisect_left(self.starts, end)
        return i == 0 or self.rows[i - 1][1] <= start

    def add(self, start: int, end: int, kind: str, new: str) -> None:
        i = bisect.bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.rows.insert(i, (start, end, kind, new))


def _take_cards(text: str, pattern: re.Pattern, key: bytes, back: bool, taken: Taken) -> None:
    """Adds the cards of a text to what is taken."""

    def take(start: int, end: int) -> bool:
        new = _card(key, text[start:end], back) if taken.free(start, end) else None
        if new is not None:
            taken.add(start, end, "card", new)
        return new is not None

    for row in _DIGIT_ROW.finditer(text):
        groups = [g.span() for g in _DIGIT_GROUP.finditer(text, row.start(), row.end())]
        for i, (start, _) in enumerate(groups):
            if text[start - 1 : start] != "-":
                for part in (groups[i : i + n] for n in (1, 3, 4)):
                    sizes = tuple(e - s for s, e in part)
                    if (len(sizes) == 1 or sizes in LAYOUTS) and take(start, part[-1][1]):
                        break
    at = 0
    while m := pattern.search(text, at):
        ends = [m.end(), *(m.start() + i for i in range(len(m[0]) - 1, 12, -1) if m[0][i] in " -")]
        at = next((e for e in ends if take(m.start(), e)), m.end())


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _iban(key: bytes, found: str, back: bool) -> str | None:
    raw = found.replace(" ", "")
    if not 15 <= len(raw) <= 34 or _mod97(raw[4:] + raw[:4]) != 1:
        return None
    body = _letters(key, f"iban{raw[:2]}", raw[4:], back)
    made = iter(raw[:2] + f"{98 - _mod97(body + raw[:2] + '00'):02d}" + body)
    return "".join(c if c == " " else next(made) for c in found)


def _ssn_valid(d: str) -> bool:
    return not (d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000")


def _ssn(key: bytes, found: str, back: bool) -> str | None:
    d = _only(found)
    if not _ssn_valid(d):
        return None
    d = _digits(key, "ssn", d, back)
    while not _ssn_valid(d):  # numbers that can't be are walked past, either way
        d = _digits(key, "ssn", d, back)
    return _fill(found, d)


def _phone(key: bytes, found: str, back: bool) -> str | None:
    d = _only(found)
    if not 10 <= len(d) <= 15:
        return None
    keep = len(d) - 10 if found[0] == "+" else 0  # the country code
    return _fill(found, d[:keep] + _digits(key, "phone", d[keep:], back))


def _ip(key: bytes, found: str, back: bool) -> str | None:
    parts = found.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    n = permute(key, b"ip", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, back)
    return ".".join(map(str, n.to_bytes(4, "big")))


def _date(key: bytes, found: str, back: bool) -> str | None:
    a, s1, b, s2, c = re.fullmatch(r"(\d+)(\D)(\d+)(\D)(\d+)", found).groups()
    order = "ymd" if len(a) == 4 else ("mdy" if s1 == "/" and int(a) <= 12 else "dmy")
    at = dict(zip(order, (a, b, c), strict=True))
    if s1 != s2 or len(at["y"]) != 4:
        return None
    try:
        day = datetime.date(int(at["y"]), int(at["m"]), int(at["d"])).toordinal() - _FIRST_DAY
    except ValueError:
        return None
    if not 0 <= day < _DAYS:
        return None
    tweak = b"date"
    while True:
        day = permute(key, tweak, day, _DAYS, back)
        new = datetime.date.fromordinal(day + _FIRST_DAY)
        if order == "ymd" or (new.month <= 12 and (order == "mdy" or s1 != "/" or new.day > 12)):
            break  # a date that would be read in another order is walked past
    pad = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
    return s1.join(pad[x] for x in order)


def _letters(key: bytes, kind: str, text: str, back: bool) -> str:
    """Each letter and digit within its own alphabet, all together as one number."""
    kinds = [next((k for k in (_LOWER, _UPPER, _DIGITS) if c in k), "") for c in text]
    value, size = 0, 1
    for c, k in zip(text, kinds, strict=True):
        if k:
            value, size = value * len(k) + k.index(c), size * len(k)
    tweak = kind + "".join("aA0."[(_LOWER, _UPPER, _DIGITS, "").index(k)] for k in kinds)
    value = _big(key, tweak.encode(), value, size, back)
    out = []
    for c, k in zip(reversed(text), reversed(kinds), strict=True):
        if k:
            value, i = divmod(value, len(k))
            c = k[i]
        out.append(c)
    return "".join(reversed(out))


def _big(key: bytes, tweak: bytes, value: int, size: int, back: bool) -> int:
    """permute() for sizes beyond floating point roots."""
    if size < 1 << 52:
        return permute(key, tweak, value, size, back)
    low = 1 << (size.bit_length() + 1) // 2
    while True:
        left, right = divmod(value, low)
        for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            if back:
                left, right = (right - _round(key, tweak, i, left, low)) % low, left
            else:
                left, right = right, (left + _round(key, tweak, i, right, low)) % low
        value = left * low + right
        if value < size:
            return value


def _email(key: bytes, found: str, back: bool) -> str | None:
    local, _, domain = found.rpartition("@")
    host, _, top = domain.rpartition(".")
    return f"{_letters(key, 'local', local, back)}@{_letters(key, 'host', host, back)}.{top}"


def _secret(key: bytes, found: str, back: bool) -> str | None:
    mark = re.match(r"(?i)AKIA|ASIA|sk_(?:live|test)_|ghp_|[a-z_]*(?:password|passwd|secret|token|api_?key)\s*[=:]\s*[\x22']?", found)
    return found[: mark.end()] + _letters(key, "secret", found[mark.end() :], back)


#: Kinds in the order in which they are tried at a place.
KINDS: dict[str, tuple[str, Callable]] = {
    "email": (r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", _email),
    "secret": (r"(?i:[a-z_]*(?:password|passwd|secret|token|api_?key)\s*[=:]\s*[\x22']?)[A-Za-z0-9+/_-]{6,}|\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bsk_(?:live|test)_[A-Za-z0-9]{16,}|\bghp_[A-Za-z0-9]{30,}", _secret),
    "iban": (r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", _iban),
    "phone": (r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-]\d)", _phone),
    "ip": (r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", _ip),
    "date": (r"(?<![\d./-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\d/-]|\.\d)", _date),
    "ssn": (r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    "card": (r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-]?\d)", _card),
}


@lru_cache(1)
def _patterns() -> tuple[re.Pattern, tuple[tuple[str, re.Pattern, Callable], ...]]:
    return re.compile(r"[0-9@=:_]"), tuple((k, re.compile(p), f) for k, (p, f) in KINDS.items())


def pseudonymise(text: str | None, key: bytes, back: bool = False) -> tuple[str | None, list[dict]]:
    """The text with pseudonyms, and what was found: kind, start, end in the text given."""
    quick, kinds = _patterns()
    if not text or not quick.search(text):
        return text, []
    taken = Taken()
    for kind, pattern, make in kinds:
        if kind == "card":
            _take_cards(text, pattern, key, back, taken)
            continue
        for m in pattern.finditer(text):
            if taken.free(*m.span()):
                new = make(key, m[0], back)
                if new is not None:
                    taken.add(*m.span(), kind, new)
    at, parts = 0, []
    for s, e, _, new in taken.rows:
        parts += [text[at:s], new]
        at = e
    return "".join([*parts, text[at:]]), [{"kind": k, "start": s, "end": e} for s, e, k, _ in taken.rows]


def pseudonyms(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (with pseudonyms), found (kind, start, end of each value) of every row."""
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("found", spans)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = [pseudonymise(t, key) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t for t, _ in made], pa.string()), pa.array([f for _, f in made], spans)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string, found array<struct<kind:string,start:long,end:long>>")
