"""Format-preserving pseudonyms for personal data and secrets.

Values are found by patterns and validated (Luhn for payment cards, mod 97 for IBANs,
octet ranges for addresses, calendar dates, ...).  Each valid value is replaced by a keyed
permutation within its own format: digits, letters and hexadecimal characters are
enciphered by a balanced Feistel network with cycle walking over exactly the values of the
format, so that punctuation, length, case classes and check digits are kept, equal values
get equal pseudonyms in every document, different values different ones, and whoever
holds the key can go back (``restore``).  Where a format is told from the value itself (a hexadecimal
secret, a date's notation), the permutation walks on until the pseudonym is told to be of it too.

Kinds: email (local part), phone (the digits after the country code; the same number in several notations has one
pseudonym), card (Luhn kept, first digit kept), iban (country kept,
check digits recomputed), ssn, ipv4 (each address permuted as 32 bits), date (any calendar
day of 1900-2099, its notation kept), access keys ("AKIA" + 16), and secrets after password,
token, secret and api key assignments; a short word of one case after token, secret or key is
not taken for one.

The key is a parameter.  DEMO_KEY only serves tests and examples: use your own.

Defined cases: null texts stay null, and count no findings; empty texts stay empty; a
value is found wherever it lies in a text of any length; equal rows give equal rows; an
empty table stays empty; all other columns are kept as they are.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import read_columns, unused

DEMO_KEY = b"touchline demonstration key"
ROUNDS = 8
LONG = 160  # characters from which on a value is permuted by halves of characters, not as one number
KINDS = ("email", "card", "iban", "phone", "ssn", "ipv4", "date", "access_key", "secret")
DIGITS, UPPER, LOWER, HEX = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
BASE32 = UPPER + DIGITS
_EPOCH, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


class Feistel:
    """A keyed permutation of 0 .. size-1: a balanced Feistel network with cycle walking."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.half = max(1, -(-max(1, (size - 1).bit_length()) // 2))
        self.mask = (1 << self.half) - 1
        self.head = hashlib.blake2b(tweak.encode() + b"|%d" % size, key=key[:64], digest_size=32).digest()
        self.n_bytes = -(-2 * self.half // 8)

    def _round(self, k: int, x: int) -> int:
        h = hashlib.blake2b(x.to_bytes(self.n_bytes, "little") + bytes([k]), key=self.head, digest_size=min(64, max(8, -(-self.half // 8))))
        return int.from_bytes(h.digest(), "little") & self.mask

    def _once(self, x: int) -> int:
        left, right = x >> self.half, x & self.mask
        for k in range(ROUNDS):
            left, right = right, left ^ self._round(k, right)
        return (left << self.half) | right

    def _back(self, x: int) -> int:
        left, right = x >> self.half, x & self.mask
        for k in reversed(range(ROUNDS)):
            left, right = right ^ self._round(k, left), left
        return (left << self.half) | right

    def forward(self, x: int) -> int:
        x = self._once(x)
        while x >= self.size:
            x = self._once(x)
        return x

    def backward(self, x: int) -> int:
        x = self._back(x)
        while x >= self.size:
            x = self._back(x)
        return x


@lru_cache(maxsize=4096)
def _cipher(key: bytes, tweak: str, size: int) -> Feistel:
    return Feistel(key, tweak, size)


def _number(chars: str, alphabets: list[str]) -> int:
    n = 0
    for c, a in zip(chars, alphabets):
        n = n * len(a) + a.index(c)
    return n


def _chars(n: int, alphabets: list[str]) -> str:
    out = []
    for a in reversed(alphabets):
        n, k = divmod(n, len(a))
        out.append(a[k])
    return "".join(reversed(out))


def _permute_long(chars: list[str], alphabets: list[str], key: bytes, tweak: str, back: bool) -> str:
    """A Feistel network over characters instead of one number: linear in the length of the value.

    Each half in turn is shifted, character by character within its alphabet, by a keyed
    stream drawn from the other half.
    """
    at = np.array([a.index(c) for c, a in zip(chars, alphabets)], np.int64)
    size = np.array([len(a) for a in alphabets], np.int64)
    half = len(at) // 2
    parts = (slice(0, half), slice(half, None))
    for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
        moved, other = parts[k % 2], parts[1 - k % 2]
        # 512-bit digest of the other half, then a stream of 32 bits for each character
        seed = hashlib.blake2b(at[other].astype("<u2").tobytes() + tweak.encode() + bytes([k]), key=key[:64]).digest()
        n = len(at[moved])
        stream = np.frombuffer(hashlib.shake_256(seed).digest(4 * n), "<u4").astype(np.int64)
        at[moved] = (at[moved] + (-stream if back else stream)) % size[moved]
    return "".join(a[i] for a, i in zip(alphabets, at.tolist()))


def permute(value: str, alphabets: list[str | None], key: bytes, tweak: str, back: bool = False) -> str:
    """Enciphers the characters that have an alphabet, as one number; the others stay."""
    own = [a for a in alphabets if a]
    if len(own) > LONG:
        new = iter(_permute_long([c for c, a in zip(value, alphabets) if a], own, key, tweak, back))
        return "".join(next(new) if a else c for c, a in zip(value, alphabets))
    size = 1
    for a in own:
        size *= len(a)
    if size < 2:
        return value
    cipher = _cipher(key, tweak, size)
    n = _number("".join(c for c, a in zip(value, alphabets) if a), own)
    new = iter(_chars((cipher.backward if back else cipher.forward)(n), own))
    return "".join(next(new) if a else c for c, a in zip(value, alphabets))


def _classes(value: str) -> list[str | None]:
    """The alphabet of each character: its class among digits, upper and lower case; others stay."""
    return [DIGITS if c in DIGITS else UPPER if c in UPPER else LOWER if c in LOWER else None for c in value]


def luhn_digit(digits: str) -> str:
    """The check digit that follows ``digits``."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


# Each kind: (pattern, replacement of a match or None if it is not valid).


def _email(m: re.Match, key: bytes, back: bool) -> str:
    local = m["local"]
    return permute(local, _classes(local), key, f"email|{m['domain'].lower()}", back) + m.group()[len(local) :]


def _card(m: re.Match, key: bytes, back: bool) -> str | None:
    value = m.group()
    digits = re.sub(r"\D", "", value)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or digits[0] == "0":
        return None
    body = permute(digits[:-1], [None] + [DIGITS] * (len(digits) - 2), key, f"card{len(digits)}{digits[0]}", back)
    new = iter(body + luhn_digit(body))
    return "".join(next(new) if c.isdigit() else c for c in value)


def _iban(m: re.Match, key: bytes, back: bool) -> str | None:
    value = m.group()
    flat = value.replace(" ", "")
    if not 15 <= len(flat) <= 34 or iban_check(flat[:2], flat[4:]) != flat[2:4]:
        return None
    rest = permute(flat[4:], _classes(flat[4:]), key, f"iban{flat[:2]}{len(flat)}", back)
    new = iter(flat[:2] + iban_check(flat[:2], rest) + rest)
    return "".join(c if c == " " else next(new) for c in value)


def _phone(m: re.Match, key: bytes, back: bool) -> str | None:
    """The country code and a trunk "(0)" stay; the national digits are permuted as one number, however they are grouped.

    A number of the North American form without a country code is one of country 1.
    """
    value = m.group()
    country, lead = "1", 0
    if value[0] == "+":
        digits = re.sub(r"\D", "", value)
        country = digits[:1] if digits[0] in "17" else digits[:2] if digits[:2] in TWO_DIGIT_COUNTRIES else digits[:3]
        lead = re.match(r"\D*".join(["", *country]), value).end()
    trunk = [k for k in range(lead, len(value) - 2) if value[k : k + 3] == "(0)"]
    digits = [c in DIGITS and k >= lead and k - 1 not in trunk for k, c in enumerate(value)]
    if not 7 <= sum(digits) <= 13:
        return None
    alphabets = [DIGITS if own else None for own in digits]
    while True:  # a group of one digit does not become a trunk
        value = permute(value, alphabets, key, f"phone{country}|{sum(digits)}", back)
        if [k for k in range(lead, len(value) - 2) if value[k : k + 3] == "(0)"] == trunk:
            return value


def _ssn(m: re.Match, key: bytes, back: bool) -> str | None:
    value = m.group()
    if not _valid_ssn(value):
        return None
    while True:  # cycle walking over the valid numbers
        value = permute(value, _classes(value), key, "ssn", back)
        if _valid_ssn(value):
            return value


def _valid_ssn(v: str) -> bool:
    return v[:3] not in ("000", "666") and v[0] != "9" and v[4:6] != "00" and v[7:] != "0000"


def _ipv4(m: re.Match, key: bytes, back: bool) -> str | None:
    octets = m.group().split(".")
    if any(int(o) > 255 or len(o) > 1 and o[0] == "0" for o in octets):
        return None
    cipher = _cipher(key, "ipv4", 1 << 32)
    n = int.from_bytes(bytes(map(int, octets)), "big")
    return ".".join(map(str, (cipher.backward if back else cipher.forward)(n).to_bytes(4, "big")))


def _date(m: re.Match, key: bytes, back: bool) -> str | None:
    """Any calendar day of 1900-2099 becomes another one in the same notation."""
    g = m.groupdict()
    if g["y1"]:
        parts, form = (g["y1"], g["m1"], g["d1"]), "{0:04d}%s{1:02d}%s{2:02d}" % (g["s1"], g["s1"])
    elif g["s2"] == "." or int(g["a2"]) > 12:
        parts, form = (g["y2"], g["b2"], g["a2"]), "{2:02d}%s{1:02d}%s{0:04d}" % (g["s2"], g["s2"])
    else:
        parts, form = (g["y2"], g["a2"], g["b2"]), "{1:02d}%s{2:02d}%s{0:04d}" % (g["s2"], g["s2"])
    try:
        day = date(*map(int, parts))
    except ValueError:
        return None
    cipher = _cipher(key, "date", _DAYS)
    n = (day - _EPOCH).days
    if not 0 <= n < _DAYS:
        return None
    if g["s2"] and g["s2"] != ".":  # days from 13 on keep their side of 13: the notation stays the same
        while True:
            n = (cipher.backward if back else cipher.forward)(n)
            if ((_EPOCH + timedelta(n)).day > 12) == (day.day > 12):
                break
    else:
        n = (cipher.backward if back else cipher.forward)(n)
    new = _EPOCH + timedelta(n)
    return form.format(new.year, new.month, new.day)


def _access_key(m: re.Match, key: bytes, back: bool) -> str:
    return m.group()[:4] + permute(m.group()[4:], [BASE32] * 16, key, "access_key", back)


def _is_hex(value: str) -> bool:
    return len(value) >= 8 and all(c in HEX for c in value) and any(c in DIGITS for c in value) and any(c in LOWER for c in value)


def _secret(m: re.Match, key: bytes, back: bool) -> str | None:
    """Hexadecimal secrets stay so; all others keep the class of each character, and do not become hexadecimal."""
    value = m["value"]
    plain = value.rstrip("/+_.~-=")
    if not m["word"].lower().startswith("pa") and m["word"].lower() != "pwd" and len(plain) < 16 and plain.isalpha() and (plain.islower() or plain.isupper() or plain.istitle()):
        return None
    hexadecimal = _is_hex(value)
    alphabets = [HEX] * len(value) if hexadecimal else _classes(value)
    tweak, new = f"{'hex' if hexadecimal else 'secret'}{len(value)}", value
    while True:  # cycle walking over the values of the format
        new = permute(new, alphabets, key, tweak, back)
        if _is_hex(new) == hexadecimal:
            break
    return m.group()[: m.start("value") - m.start()] + new + m.group()[m.end("value") - m.start() :]


_EDGE = r"(?<![A-Za-z0-9])"
#: Country calling codes of two digits; 1 and 7 have one, all others three (fixed values).
TWO_DIGIT_COUNTRIES = frozenset(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)
#: Countries by the length of their IBANs, so that a word after one is not taken for its end.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ",
    24: "AD CZ ES MD PK RO SA SE SK TN", 25: "LY PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT", 32: "LC",
}
_IBANS = "|".join(rf"(?:{c.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + "(?![A-Za-z0-9])" for n, c in IBAN_LENGTHS.items())
RULES: dict[str, tuple[re.Pattern, Callable[[re.Match, bytes, bool], str | None]]] = {
    "secret": (re.compile(r"(?P<word>(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key))[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?P<value>[A-Za-z0-9/+_.~-]{6,}={0,2})"), _secret),
    "access_key": (re.compile(_EDGE + r"A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])"), _access_key),
    "email": (re.compile(r"(?P<local>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64})@(?P<domain>[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}[A-Za-z0-9])?(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24})"), _email),
    "iban": (re.compile(_EDGE + rf"(?:{_IBANS}|" + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"), _iban),
    "card": (re.compile(r"(?<![\dA-Za-z+.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{4,5})(?![\dA-Za-z])"), _card),
    "ssn": (re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), _ssn),
    "date": (re.compile(r"(?<![\d./-])(?:(?P<y1>(?:19|20)\d\d)(?P<s1>[-/.])(?P<m1>\d\d)(?P=s1)(?P<d1>\d\d)|(?P<a2>\d\d)(?P<s2>[-/.])(?P<b2>\d\d)(?P=s2)(?P<y2>(?:19|20)\d\d))(?![\d/-]|\.\d)"), _date),
    "ipv4": (re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"), _ipv4),
    "phone": (re.compile(r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+(?!1)\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d|\.\d)|(?<![\d+(A-Za-z.-])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\d-])"), _phone),
}


def pseudonymise(text: str, key: bytes = DEMO_KEY, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each finding in the given text.

    Kinds are tried in the order of RULES; findings do not overlap.  With ``back`` the
    pseudonyms are turned into the first values again.
    """
    taken: list[tuple[int, int, str, str]] = []  # in the order of their places; they do not overlap
    if any(c in text for c in "0123456789@=:"):
        for kind, (pattern, replace) in RULES.items():
            for m in pattern.finditer(text):
                at = bisect_left(taken, (m.start(),))
                if at < len(taken) and taken[at][0] < m.end() or at and taken[at - 1][1] > m.start():
                    continue
                new = replace(m, key, back)
                if new is not None:
                    taken.insert(at, (m.start(), m.end(), kind, new))
    if not taken:
        return text, []
    out, at = [], 0
    for a, b, _, new in taken:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [(kind, a, b) for a, b, kind, _ in taken]


def restore(text: str, key: bytes) -> str:
    """Turns pseudonyms back, for whoever holds the key."""
    return pseudonymise(text, key, back=True)[0]


def _replacer(key: bytes, text_col: str, chars_col: str | None, spans: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(None, []) if t is None else pseudonymise(t, key) for t in batch.column(text_col).to_pylist()]
            columns = dict(zip(batch.schema.names, batch.columns))
            columns[text_col] = pa.array([t for t, _ in got], pa.string())
            if chars_col:
                columns[chars_col] = pa.array([None if t is None else len(t) for t, _ in got], pa.int64()).cast(batch.schema.field(chars_col).type)
            if spans:
                kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
                columns[spans] = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in f] for _, f in got], pa.list_(kind))
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return run


def pseudonymise_column(docs: DataFrame, key: bytes = DEMO_KEY, text_col: str = "text", chars_col: str | None = None, spans_col: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``; optionally code points, and findings in ``spans_col``.

    Spans give kind, start and end in the given text.  A map over the rows, no shuffle.
    """
    spans = unused(docs, "found") if spans_col else None
    schema = docs.limit(0).select("*", *([F.lit(None).cast("array<struct<kind:string,start:long,end:long>>").alias(spans)] if spans else [])).schema
    out = docs.mapInArrow(_replacer(key, text_col, chars_col, spans), schema)
    return out.withColumnRenamed(spans, spans_col) if spans else out


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its pseudonymised text and the number of findings of each kind."""
    out = pseudonymise_column(read_columns(spark, sf_dir, "documents", "doc_id", "text"), spans_col="found")
    n = [F.expr(f"cast(size(filter(found, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", "text", F.size("found").cast("long").alias("n_found"), *n)
