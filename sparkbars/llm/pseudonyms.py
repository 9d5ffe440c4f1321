"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

A value is validated, read as a number within its format (valid card numbers of so many digits, days, addresses), and
that number is permuted by a Feistel network over the format's whole range, walked until it falls inside. So a value
becomes another valid one of its format, equal values become equal however they are written or in whichever document,
and ``restore`` with the same key gives them back.

Kinds: email (the letters and digits of the local part), card (13 to 19 digits, Luhn, not all equal), iban (mod 97; country
and length stay), ip (IPv4), ssn, phone (NANP, or + and a country code, which stays), date (year first with hyphens, a
time may follow, or slashes; day and month with dots or slashes, and month first with slashes where day first is
impossible). What fails validation stays as it is. Of kinds that could begin at one place the first named wins.

Null text stays null, empty text empty. Repeated rows are replaced each, and alike. Empty tables give empty results. Other
columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
KINDS = ("email", "ip", "iban", "card", "ssn", "phone", "date")
#: How each kind is written.
PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9](?:[\w.+-]{0,62}[A-Za-z0-9])?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d))"
    r"|(?P<date>(?<![\w/.-])(?:\d{4}-\d{1,2}-\d{1,2}(?=T\d\d)|(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-]|\.\d)))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<iban>(?<![\w-])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: (?=[A-Z]*\d)[A-Z0-9]{1,3})?)(?![\w-]))"
    r"|(?P<abroad>(?<![\w+-])\+(?!1\D?\d)\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){2,5}(?![\w-]|\.\d))"
    r"|(?P<phone>(?<![\w-])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))",
    re.A,
)
#: A text without a digit has none of the kinds, but for an email.
MAYBE = re.compile(r"[0-9@]")


def feistel(x: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of range(size)."""
    if size < 2:
        return x
    a = isqrt(size - 1) + 1
    b = -(-size // a)

    def mixed(i: int, v: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}|{size}|{i}|{v}".encode(), key=key, digest_size=16).digest(), "big")

    while True:
        left, right = divmod(x, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            step = -1 if back else 1
            if i % 2:
                right = (right + step * mixed(i, left)) % b
            else:
                left = (left + step * mixed(i, right)) % a
        x = left * b + right
        if x < size:
            return x


def _digits(text: str) -> str:
    return re.sub(r"\D", "", text)


def _refill(text: str, digits: str) -> str:
    """``text`` with its digits replaced in order."""
    rest = iter(digits)
    return re.sub(r"\d", lambda _: next(rest), text)


def luhn(payload: str) -> str:
    """The check digit that follows ``payload``."""
    total = sum(sum(divmod(int(d) * (2 - k % 2), 10)) for k, d in enumerate(reversed(payload)))
    return str(-total % 10)


def _card(text: str, permute: Callable) -> str | None:
    d = _digits(text)
    if not 13 <= len(d) <= 19 or luhn(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    payload = int(d[:-1])
    while True:  # past numbers of one digit alone, which are not replaced
        payload = permute(payload, 10 ** (len(d) - 1), f"card{len(d)}")
        new = str(payload).zfill(len(d) - 1)
        new += luhn(new)
        if len(set(new)) > 1:
            return _refill(text, new)


def _iban(text: str, permute: Callable) -> str | None:
    """Letters stay letters and digits digits; the check digits follow from the rest."""
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    x, size, shape = 0, 1, plain[:2]
    for c in plain[4:]:
        radix, value = (26, ord(c) - 65) if c.isalpha() else (10, int(c))
        x, size, shape = x * radix + value, size * radix, shape + ("A" if radix == 26 else "0")
    x, new = permute(x, size, f"iban {shape}"), ""
    for c in reversed(plain[4:]):
        x, value = divmod(x, 26 if c.isalpha() else 10)
        new = (chr(65 + value) if c.isalpha() else str(value)) + new
    new = plain[:2] + f"{98 - number(new + plain[:2] + '00') % 97:02d}" + new
    rest = iter(new)
    return re.sub(r"\S", lambda _: next(rest), text)


def _abroad(text: str, permute: Callable) -> str | None:
    """The country code, up to where the number is first divided (two digits if it isn't), stays."""
    d = _digits(text)
    code = min(len(re.match(r"\+(\d+)", text)[1]), 2 if text[1:].isdigit() else 3)
    if not 8 <= len(d) <= 15 or len(d) - code < 6:
        return None
    rest = len(d) - code
    return _refill(text, d[:code] + str(permute(int(d[code:]), 10**rest, f"abroad{d[:code]}")).zfill(rest))


def _ip(text: str, permute: Callable) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255 or any(str(p) != s for p, s in zip(parts, text.split("."))):
        return None
    x = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ssn(text: str, permute: Callable) -> str | None:
    areas = [n for n in range(1, 900) if n != 666]
    area, group, serial = map(int, text.split("-"))
    if area not in areas or not group or not serial:
        return None
    x = permute((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999, "ssn")
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(text: str, permute: Callable) -> str | None:
    d = _digits(text)
    country, d = d[:-10], d[-10:]
    if d[0] in "01" or d[3] in "01":
        return None
    area, exchange, line = int(d[:3]) - 200, int(d[3:6]) - 200, int(d[6:])
    x, line = divmod(permute((area * 800 + exchange) * 10_000 + line, 800 * 800 * 10_000, "phone"), 10_000)
    area, exchange = divmod(x, 800)
    return _refill(text, f"{country}{area + 200}{exchange + 200}{line:04d}")


#: Years from 1900 to 2099 are permuted among each other, others among all other years.
_YEARS = {"date": range(1900, 2100), "other date": [*range(1, 1900), *range(2100, 10_000)]}


def _shape(month: int, day: int) -> tuple[bool, bool, bool]:
    """What a date keeps, so that each spelling of it (without zeros, month first) is read again as it was written."""
    return month > 9, day > 9, day > 12


#: Days of a leap year by their shape.
_DAYS = {shape: [x for x in ((m, d) for m in range(1, 13) for d in range(1, 32)) if _shape(*x) == shape and (x[1] <= 29 or x not in {(2, 30), (2, 31), (4, 31), (6, 31), (9, 31), (11, 31)})] for shape in {_shape(m, d) for m in (1, 10) for d in (1, 10, 13)}}


def _is_date(year: int, month: int, day: int) -> bool:
    try:
        return bool(date(year, month, day))
    except ValueError:
        return False


def _date(text: str, permute: Callable) -> str | None:
    parts = re.split(r"[-/.]", text)
    order = (0, 1, 2) if len(parts[0]) == 4 else (2, 1, 0)  # where year, month and day stand
    if "/" in text and order[0] == 2 and int(parts[1]) > 12:
        order = (2, 0, 1)
    y, m, d = (int(parts[k]) for k in order)
    if not _is_date(y, m, d):
        return None
    kind = "date" if y in _YEARS["date"] else "other date"
    years, days = _YEARS[kind], _DAYS[_shape(m, d)]
    x, size = years.index(y) * len(days) + days.index((m, d)), len(years) * len(days)
    while True:  # past 29 February of common years
        x = permute(x, size, f"{kind} {_shape(m, d)}")
        new = (years[x // len(days)], *days[x % len(days)])
        if _is_date(*new):
            break
    for k, value in zip(order, new):
        parts[k] = str(value).zfill(len(parts[k]))
    sep = re.search(r"[-/.]", text)[0]
    return sep.join(parts)


def _email(text: str, permute: Callable) -> str | None:
    local, _, domain = text.partition("@")
    x, size, shape = 0, 1, ""
    for c in local:
        radix, value = (26, ord(c.lower()) - 97) if c.isalpha() else (10, int(c)) if c.isdigit() else (1, 0)
        x, size, shape = x * radix + value, size * radix, shape + ("a" if radix == 26 else "0" if radix == 10 else c)
    x = permute(x, size, f"email {shape}@{domain.lower()}")
    out = []
    for c in reversed(local):
        radix = 26 if c.isalpha() else 10 if c.isdigit() else 1
        x, value = divmod(x, radix)
        out.append(c if radix == 1 else str(value) if radix == 10 else chr(97 + value).upper() if c.isupper() else chr(97 + value))
    return "".join(reversed(out)) + "@" + domain


_RULES = {"email": _email, "ip": _ip, "iban": _iban, "card": _card, "ssn": _ssn, "abroad": _abroad, "phone": _phone, "date": _date}


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of the values in ``text``. back: restores them."""
    if not MAYBE.search(text):
        return text, []
    permute = lambda x, size, tweak: feistel(x, size, key, tweak, back)
    spans: list[tuple[str, int, int]] = []

    def one(m: re.Match) -> str:
        new = _RULES[m.lastgroup](m[0], permute)
        if new is None:
            return m[0]
        spans.append(("phone" if m.lastgroup == "abroad" else m.lastgroup, m.start(), m.end()))
        return new

    return PATTERN.sub(one, text), spans


_OUT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), *((f"n_{k}", pa.int64()) for k in KINDS), ("spans", pa.string())])


def pseudonymise_documents(docs: DataFrame, key: bytes, back: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (with pseudonyms), n_<kind> for each kind, spans (kind:start:end in the given text, comma-joined)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in _OUT.names}
            for doc_id, raw in zip(batch.column(0), batch.column(1)):
                text, spans = pseudonymise(raw.as_py(), key, back) if raw.is_valid else (None, [])
                counts = [sum(1 for s in spans if s[0] == k) for k in KINDS]
                for name, value in zip(_OUT.names, (doc_id.as_py(), text, *counts, ",".join(f"{k}:{a}:{b}" for k, a, b in spans))):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, _OUT)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(task, "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in KINDS) + ", spans string")
