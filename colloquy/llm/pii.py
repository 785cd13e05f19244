"""Personal data: format-preserving pseudonyms by keyed Feistel permutations.

Candidates of each kind are found by pattern and validated: card numbers by their check digit, IBANs
by mod 97 (both at every length that a start admits, the longest or the country's own first), IPv4 octets by range, dates by the calendar, social security numbers by their
blocks, e-mail addresses and telephone numbers by shape. A valid value is numbered within the
values of its format, the number is permuted by a Feistel network keyed with a secret, and the result
is written back in the same format: a valid card number becomes another valid card number of equal
length, a date another date written alike. The permutation is one-to-one, so equal values stay
equal and different ones different in all documents, and the holder of the key can go back.

A network over a*b >= size values walks on until it is inside the format (cycle walking), which keeps it a
permutation of the format's values. (Like any permutation it may leave one value in a format's
whole number of values as it is.)

Defined cases: a null text stays null and has no spans; spans are in code points of the input text with
the end exclusive; overlapping candidates: the earlier wins, then the longer, then the kind listed first;
repeated rows get equal results, a row each; an empty table gives an empty result; other
columns are ignored by :func:`pseudonymize` and passed through by :func:`replace`.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "phone", "card", "ip", "iban", "ssn", "date")
KEY = b"replace this key in production"
ROUNDS = 8

PHONE = re.compile(r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}")
IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9]{4} ?[A-Z0-9]{4})")
#: Every number of groups an IBAN can have, with and without a shorter last one.
IBANS = [re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){%d}%s(?![A-Za-z0-9])" % (n, rest)) for n in range(7, 1, -1) for rest in (" ?[A-Z0-9]{1,3}", "")]
IBAN_LENGTHS = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC"}.items() for c in cs.split()}
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
DATE = re.compile(r"(?<![0-9])(?:((?:19|20)[0-9]{2})([-/.])([0-9]{1,2})\2([0-9]{1,2})|([0-9]{1,2})([-/.])([0-9]{1,2})\6((?:19|20)[0-9]{2}))(?![0-9])")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}$")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")
_DAY0, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


# --- permutation -------------------------------------------------------------------------
class Permutation:
    """Keyed permutation of 0..size-1 for any size and tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key).digest()

    def _round(self, i: int, value: int, tweak: bytes, modulus: int) -> int:
        h = hashlib.blake2b(b"%d|%d|%d|" % (i, modulus, value) + tweak, key=self.key, digest_size=8 + (modulus.bit_length() + 7) // 8)
        return int.from_bytes(h.digest(), "big") % modulus

    def _step(self, x: int, a: int, b: int, tweak: bytes, back: bool) -> int:
        left, right = divmod(x, b)
        for i in (reversed(range(ROUNDS)) if back else range(ROUNDS)):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * self._round(i, left, tweak, b)) % b
            else:
                left = (left + sign * self._round(i, right, tweak, a)) % a
        return left * b + right

    def walk(self, x: int, size: int, tweak: bytes, back: bool = False) -> int:
        if size < 2:
            return x
        a = max(2, _root(size))
        b = -(-size // a)
        x = self._step(x, a, b, tweak, back)
        while x >= size:
            x = self._step(x, a, b, tweak, back)
        return x

    def __call__(self, x: int, size: int, tweak: bytes) -> int:
        return self.walk(x, size, tweak)

    def inverse(self, y: int, size: int, tweak: bytes) -> int:
        return self.walk(y, size, tweak, back=True)


def _root(n: int) -> int:
    import math
    return math.isqrt(n - 1) + 1


# --- formats: a number within the format's values, and back ------------------------------
def luhn_digit(digits: str) -> str:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _like(shape: str, characters: str) -> str:
    """Letters and digits of ``shape`` replaced in order, all else kept."""
    it = iter(characters)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _mixed(text: str) -> tuple[int, int]:
    """Number and count of the strings that have a digit, small or capital letter where this one has."""
    x, size = 0, 1
    for c in text:
        base, radix = _class(c)
        x, size = x * radix + ord(c) - base, size * radix
    return x, size


def _class(c: str) -> tuple[int, int]:
    return (48, 10) if c.isdigit() else (97, 26) if c.islower() else (65, 26)


def _unmixed(x: int, text: str) -> str:
    out = []
    for c in reversed(text):
        base, radix = _class(c)
        x, r = divmod(x, radix)
        out.append(chr(base + r))
    return "".join(reversed(out))


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


class Pseudonyms:
    """Finds valid values and gives each its pseudonym."""

    def __init__(self, key: bytes = KEY):
        self.permute = Permutation(key)

    def _string(self, text: str, tweak: bytes) -> str:
        x, size = _mixed(text)
        return _unmixed(self.permute(x, size, tweak), text)

    def email(self, value: str) -> str:
        local, _, domain = value.partition("@")
        return _like(local, self._string("".join(c for c in local if c.isalnum()), b"email" + domain.lower().encode())) + "@" + domain

    def phone(self, value: str) -> str:
        """The country code stays; the same number in another spelling gets the same digits."""
        code = re.match(r"\+[0-9]{1,3}(?=[ .(-])|\+[0-9]", value)
        head = code[0] if code else ""
        digits = "".join(c for c in value[len(head):] if c.isdigit())
        return head + _like(value[len(head):], self._string(digits, b"phone" + head.encode()))

    def card(self, value: str) -> str:
        digits = "".join(c for c in value if c.isdigit())
        new = self._string(digits[:-1], b"card")
        return _like(value, new + luhn_digit(new))

    def ip(self, value: str) -> str:
        x = 0
        for part in value.split("."):
            x = x * 256 + int(part)
        y = self.permute(x, 1 << 32, b"ip")
        return ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))

    def iban(self, value: str) -> str:
        plain = value.replace(" ", "")
        rest = self._string(plain[4:], b"iban" + plain[:2].encode())
        return _like(value, plain[:2] + iban_check(plain[:2], rest) + rest)

    def ssn(self, value: str) -> str:
        a, b, c = map(int, value.split("-"))
        area = a - 1 - (a > 666)
        x = (area * 99 + b - 1) * 9999 + c - 1
        y = self.permute(x, 898 * 99 * 9999, b"ssn")
        y, c = divmod(y, 9999)
        a, b = divmod(y, 99)
        return f"{a + 1 + (a >= 665):03d}-{b + 1:02d}-{c + 1:04d}"

    def date(self, value: str) -> str:
        day, write = read_date(value)
        return write(datetime.date.fromordinal(_DAY0 + self.permute(day.toordinal() - _DAY0, _DAYS, b"date")))

    def of(self, kind: str, value: str) -> str:
        return getattr(self, kind)(value)


def read_date(value: str):
    """The day and a writer of other days in the same spelling; ``None`` when the calendar has no such day."""
    m = DATE.fullmatch(value)
    if not m:
        return None
    first = m[1] is not None
    sep = m[2] if first else m[6]
    year, x, y = (int(m[1]), m[3], m[4]) if first else (int(m[8]), m[7], m[5])
    swapped = not first and int(x) > 12 >= int(y)  # month first
    month, day = (y, x) if swapped else (x, y)
    try:
        date = datetime.date(year, int(month), int(day))
    except ValueError:
        return None
    two = len(x) == 2 and len(y) == 2

    def write(d: datetime.date) -> str:
        mm, dd = (f"{d.month:02d}", f"{d.day:02d}") if two else (str(d.month), str(d.day))
        parts = [str(d.year), mm, dd] if first else [mm, dd, str(d.year)] if swapped else [dd, mm, str(d.year)]
        return sep.join(parts)

    return date, write


def _emails(text: str):
    at = text.find("@")
    while at >= 0:
        left = _LOCAL.search(text, max(0, at - 64), at)
        right = _DOMAIN.match(text, at + 1)
        if left and right:
            start = left.start()
            while start < at and not text[start].isalnum():
                start += 1
            if start < at and any(c.isascii() and c.isalnum() for c in text[start:at]):
                yield start, right.end()
        at = text.find("@", at + 1)


def _cards(text: str):
    """At each start the longest run of 13 to 19 digits whose check digit is right; the search goes on after it, or after the start."""
    m = CARD.search(text)
    while m:
        ends = [i + 1 for i in range(m.start(), m.end()) if text[i].isdigit()]
        digits = "".join(text[i - 1] for i in ends)
        upto = m.start() + 1
        for n in range(len(ends), 12, -1):
            if (not text[ends[n - 1]:ends[n - 1] + 1].isdigit() and len(set(digits[:n])) > 1
                    and luhn_digit(digits[:n - 1]) == digits[n - 1]):
                upto = ends[n - 1]
                yield m.start(), upto
                break
        m = CARD.search(text, upto)


def _ibans(text: str):
    """At each start the value of its country's length if it is right, or else the longest right one."""
    m = IBAN.search(text)
    while m:
        ends = {x.end() for x in (p.match(text, m.start()) for p in IBANS) if x}
        plain = {e: text[m.start():e].replace(" ", "") for e in ends}
        usual = IBAN_LENGTHS.get(m[0][:2])
        upto = m.start() + 1
        for e in sorted(ends, key=lambda e: (len(plain[e]) != usual, -e)):
            x = plain[e]
            if 15 <= len(x) <= 34 and iban_check(x[:2], x[4:]) == x[2:4]:
                upto = e
                yield m.start(), e
                break
        m = IBAN.search(text, upto)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of all valid values, overlaps included."""
    found = [(s, e, 0) for s, e in _emails(text)]
    found += [(m.start(), m.end(), 1) for m in PHONE.finditer(text)]
    found += [(s, e, 2) for s, e in _cards(text)]
    found += [(m.start(), m.end(), 3) for m in IP.finditer(text) if all(int(x) < 256 for x in m[0].split("."))]
    found += [(s, e, 4) for s, e in _ibans(text)]
    found += [(m.start(), m.end(), 5) for m in SSN.finditer(text)
              if 0 < int(m[1]) < 900 and int(m[1]) != 666 and int(m[2]) and int(m[3])]
    found += [(m.start(), m.end(), 6) for m in DATE.finditer(text) if read_date(m[0])]
    return found


def spans(text: str) -> list[tuple[int, int, int]]:
    """Disjoint values: the earlier wins, then the longer, then the kind listed first."""
    out, upto = [], 0
    for s, e, k in sorted(candidates(text), key=lambda x: (x[0], -x[1], x[2])):
        if s >= upto:
            out.append((s, e, k))
            upto = e
    return out


def rewritten(text: str, found: list[tuple[int, int, int]], names: Pseudonyms) -> str:
    out, at = [], 0
    for s, e, k in found:
        out += [text[at:s], names.of(KINDS[k], text[s:e])]
        at = e
    return "".join(out) + text[at:]


SCHEMA = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", spans string, text string"


def pseudonymize(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """One row per document: counts, spans (kind:start:end) and the text with pseudonyms. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for b in batches:
            texts = b.column("text").to_pylist()
            found = [spans(t) if t else [] for t in texts]
            counts = [[sum(x[2] == k for x in f) for f in found] for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array([",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in f) for f in found], pa.string()),
                 pa.array([rewritten(t, f, names) if f else t for t, f in zip(texts, found, strict=True)], pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "spans", "text"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def replace(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """The documents with pseudonyms in ``text``; all rows and other columns stay."""
    schema = docs.schema
    at = schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for b in batches:
            cols = list(b.columns)
            cols[at] = pa.array([rewritten(t, spans(t), names) if t else t for t in b.column(at).to_pylist()], cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.mapInArrow(run, schema)
