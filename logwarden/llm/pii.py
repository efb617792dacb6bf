"""Format-preserving pseudonyms of personal numbers and dates by a keyed Feistel permutation.

Numbers and dates that pass validation (check digits, ranges, calendar) are replaced by others of
the same format. A value is a number of its format's domain, which the Feistel network permutes
under the key, walking on while it lands outside. Equal values become equal pseudonyms in whatever
document and punctuation, so they stay linked, and the key's holder can turn them back.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

ROUNDS = 8
#: The span of dates that are permuted among themselves.
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


#: Bits of the largest domain that is permuted at once; longer values are cut into blocks.
DOMAIN_BITS = 256


def _round(key: bytes, tweak: bytes, n: int, value: int) -> int:
    """A number of 16 bytes more than half a domain has, so that its remainders are as good as even."""
    hashed = hashlib.blake2b(value.to_bytes(DOMAIN_BITS // 16 + 1, "big") + bytes([n]) + tweak, key=key, digest_size=DOMAIN_BITS // 16 + 16)
    return int.from_bytes(hashed.digest(), "big")


def permute(value: int, size: int, key: bytes, tweak: str | bytes, back: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1, and its inverse; size has up to DOMAIN_BITS bits."""
    if size < 2:
        return value
    if size.bit_length() > DOMAIN_BITS:
        raise ValueError(f"a domain has up to {DOMAIN_BITS} bits")
    tweak = tweak.encode() if isinstance(tweak, str) else tweak
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        for n in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if n % 2 == 0:
                left = (left + sign * _round(key, tweak, n, right)) % a
            else:
                right = (right + sign * _round(key, tweak, n, left)) % b
        value = left * b + right
        if value < size:
            return value


#: Classes of characters that are permuted among themselves: of names, and of hexadecimal numbers.
LATIN = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
HEXADECIMAL = ("0123456789", "abcdef", "ABCDEF")


def _blocks(sizes: list[int]) -> list[tuple[int, int]]:
    """Runs of places, as few as will do, whose choices make up a domain of up to DOMAIN_BITS bits each; all about equal."""
    own = [math.log2(n) for n in sizes]
    bits = sum(own)
    many = max(1, math.ceil(bits / (DOMAIN_BITS - 8)))
    out, start, before, block = [], 0, 0.0, 0
    for k, x in enumerate(own):
        at = min(many - 1, int(many * (before + x / 2) / bits)) if bits else 0
        if at > block:
            out.append((start, k))
            start, block = k, at
        before += x
    return [*out, (start, len(sizes))]


def permute_characters(text: str, key: bytes, tweak: str, back: bool = False, alphabet: tuple[str, ...] = LATIN) -> str:
    """Permute the alphabet's characters, each within its class and place; other characters stay.

    A text of more choices than one domain holds is permuted block by block, once from the front,
    each block under a hash of the blocks before it, and once from the end, under one of those behind
    it. So every character depends on all, and the work grows with the length.
    """
    classes = [next((own for own in alphabet if c in own), c) for c in text]
    sizes = [len(own) for own in classes]
    values = [own.index(c) for c, own in zip(text, classes, strict=True)]
    shape = hashlib.blake2b("".join(own[0] for own in classes).encode(), key=key, person=b"shape", digest_size=32).digest()
    blocks = _blocks(sizes)

    def block(a: int, b: int, under: bytes) -> None:
        size, value = 1, 0
        for k in range(a, b):
            size, value = size * sizes[k], value * sizes[k] + values[k]
        value = permute(value, size, key, under, back)
        for k in range(b - 1, a - 1, -1):
            value, values[k] = divmod(value, sizes[k])

    def sweep(order: list[tuple[int, int]], under: bytes) -> None:
        # a block's tweak is made of what the blocks before it are turned into, which the inverse knows as well
        for a, b in order:
            known = bytes(values[a:b]) if back else b""
            block(a, b, under)
            under = hashlib.blake2b(under + (known or bytes(values[a:b])), key=key, digest_size=32).digest()

    begin = tweak.encode() + b":" + shape
    sweeps = [(blocks, begin), (blocks[::-1], begin + b":back")] if len(blocks) > 1 else [(blocks, begin)]
    for order, under in reversed(sweeps) if back else sweeps:
        sweep(order, under)
    return "".join(own[v] for own, v in zip(classes, values, strict=True))


def luhn_digit(payload: str) -> str:
    total = sum(sum(divmod(int(d) * (2 - k % 2), 10)) for k, d in enumerate(reversed(payload)))
    return str(-total % 10)


def refill(shape: str, digits: str) -> str:
    """Put digits where ``shape`` has digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


#: The first four digits of card numbers, by issuer, and how many digits follow in all.
ISSUERS = [(re.compile(pattern), lengths) for pattern, lengths in (
    (r"4\d{3}", (13, 16, 19)), (r"5[1-5]\d\d|222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720", (16,)), (r"3[47]\d\d", (15,)), (r"30[0-5]\d|3[689]\d\d", range(14, 20)),
    (r"352[89]|35[3-8]\d", range(16, 20)), (r"6011|64[4-9]\d|65\d\d|62\d\d", range(16, 20)), (r"5018|5020|5038|5893|6304|6759|676[1-3]", range(13, 20)),
)]


def card(text: str, key: bytes, back: bool = False) -> str | None:
    """A number of an issuer with a right check digit; the issuer's four digits stay."""
    digits = re.sub(r"\D", "", text)
    known = any(pattern.match(digits) and len(digits) in lengths for pattern, lengths in ISSUERS)
    if not known or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    payload = digits[:4] + permute_characters(digits[4:-1], key, f"card:{digits[:4]}", back)
    return refill(text, payload + luhn_digit(payload))


def phone(text: str, key: bytes, back: bool = False) -> str | None:
    """The last seven digits are permuted; country and area stay."""
    digits = re.sub(r"\D", "", text)
    if not (9 if text[0] == "+" else 10) <= len(digits) <= 15:
        return None
    return refill(text, digits[:-7] + permute_characters(digits[-7:], key, f"phone:{digits[-10:-7]}", back))


def social(text: str, key: bytes, back: bool = False) -> str | None:
    area, group, serial = (int(x) for x in re.findall(r"\d+", text))
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    at = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    at = permute(at, 898 * 99 * 9999, key, "social", back)
    at, serial = divmod(at, 9999)
    area, group = divmod(at, 99)
    return refill(text, f"{area + 1 + (area >= 665):03d}{group + 1:02d}{serial + 1:04d}")


def address(text: str, key: bytes, back: bool = False) -> str | None:
    """Dotted IPv4 with every part below 256."""
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    value = int.from_bytes(bytes(parts), "big")
    return ".".join(map(str, permute(value, 1 << 32, key, "ipv4", back).to_bytes(4, "big")))


def date(text: str, key: bytes, back: bool = False) -> str | None:
    """Year first, day first, or month first where the day is over 12.

    Days up to 12 are permuted among themselves, and so are those over 12: a date that only reads
    month first stays one, and a date becomes the same date in whatever order it is written.
    """
    parts, sign = re.findall(r"\d+", text), re.search(r"\D", text).group()
    if len(parts[0]) == 4:
        order, (y, m, d) = "ymd", map(int, parts)
    elif int(parts[1]) > 12:
        order, (m, d, y) = "mdy", map(int, parts)
    else:
        order, (d, m, y) = "dmy", map(int, parts)
    try:
        day = dt.date(y, m, d).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    while True:
        day = FIRST_DAY + permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date", back)
        new = dt.date.fromordinal(day)
        if (new.day > 12) == (d > 12):
            break
    shown = {"y": f"{new:%Y}", "m": f"{new:%m}", "d": f"{new:%d}"}
    return sign.join(shown[c] for c in order)


#: The length of an account number by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18,
    "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def iban_digits(country: str, rest: str) -> str:
    """The two check digits of an account number."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def iban(text: str, key: bytes, back: bool = False) -> str | None:
    """An account number of its country's length, which may be followed by another word."""
    size, n = IBAN_LENGTHS.get(text[:2], 0), 0
    for at, c in enumerate(text):
        n += c != " "
        if n == size:
            break
    else:
        return None
    own, tail = text[: at + 1], text[at + 1 :]
    plain = own.replace(" ", "")
    if tail[:1].isalnum() or plain[2:4] != iban_digits(plain[:2], plain[4:]):
        return None
    rest = permute_characters(plain[4:], key, f"iban:{plain[:2]}", back)
    it = iter(plain[:2] + iban_digits(plain[:2], rest) + rest)
    return "".join(c if c == " " else next(it) for c in own) + tail


def ipv6(text: str, key: bytes, back: bool = False) -> str | None:
    """Hexadecimal digits are permuted within the notation, so equal addresses link if they are written alike."""
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return None
    return permute_characters(text, key, "ipv6", back, HEXADECIMAL) if re.search("[1-9A-Fa-f]", text) and len(text) > 7 else None


def email(text: str, key: bytes, back: bool = False) -> str | None:
    name, at, host = text.rpartition("@")
    return permute_characters(name, key, "email", back) + at + host


def token(text: str, key: bytes, back: bool = False) -> str | None:
    return permute_characters(text, key, "token", back, HEXADECIMAL) if re.search(r"\d", text) and re.search(r"[A-Za-z]", text) else None


_NAME, _HOST = re.compile(r"[A-Za-z0-9._%+\-]*"), re.compile(r"[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+")


def find_emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of addresses, found from their signs: the name is looked for backwards, as far as the sign before."""
    before = 0
    at = text.find("@")
    while at >= 0:
        host = _HOST.match(text, at + 1)
        if host:
            name = _NAME.match(text[before:at][::-1]).group()[::-1].lstrip("._%+-")
            if name:
                yield at - len(name), host.end()
        before = host.end() if host else at + 1
        at = text.find("@", at + 1)


def _finder(pattern: str) -> Callable[[str], Iterator[tuple[int, int]]]:
    compiled = re.compile(pattern)
    return lambda text: (m.span() for m in compiled.finditer(text))


#: Kinds in the order in which they are tried at a place. No pattern looks at a character more than some dozens of times.
KINDS: list[tuple[str, Callable[[str], Iterator[tuple[int, int]]], Callable[..., str | None]]] = [
    ("email", find_emails, email),
    ("token", _finder(r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,64}(?![A-Za-z0-9])"), token),
    ("iban", _finder(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,34}(?![A-Za-z0-9])"), iban),
    ("ipv6", _finder(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,8}(?![0-9A-Za-z:])"), ipv6),
    ("date", _finder(r"(?<![\d.\-/])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?![\d\-/]|\.\d)"), date),
    ("social", _finder(r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"), social),
    ("ipv4", _finder(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"), address),
    ("card", _finder(r"(?<!\d)(?:\d{13,19}|\d{4}([ \-])\d{4}(?:\1\d{4}){2}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d)"), card),
    ("phone", _finder(r"(?<![\d+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)|(?<![\d+])\+\d{10,15}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .\-/]\d{2,8}){2,4}(?![ .\-/]?\d)"), phone),
]

_MAYBE = re.compile(r"\d")
#: Longer values are not kept in the cache of pseudonyms.
CACHED_LENGTH = 200


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of what was replaced, in the old text."""
    if not text or not _MAYBE.search(text) and "@" not in text:
        return text, []
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))
    for kind, spans, make in KINDS:
        for a, b in spans(text):
            if taken.find(1, a, b) >= 0:
                continue
            new = _cached(make, text[a:b], key, back) if b - a <= CACHED_LENGTH else make(text[a:b], key, back)
            if new is not None:
                found.append((a, b, kind, new))
                taken[a:b] = b"\1" * (b - a)
    found.sort()
    out, at = [], 0
    for a, b, _, new in found:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [(kind, a, b) for a, b, kind, _ in found]


@lru_cache(maxsize=50_000)
def _cached(make: Callable[..., str | None], text: str, key: bytes, back: bool) -> str | None:
    return make(text, key, back)


def pseudonymise_documents(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """doc_id, text, n_replaced, spans (kind, start, end in characters of the old text), one row a row.

    A null text stays null, an empty one empty. Repeated rows are treated alike. Other columns are
    ignored. Rows never leave their task: nothing is shuffled.
    """
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                done = [(None, []) if t is None else pseudonymise(t, key, back) for t in part.column(1).to_pylist()]
                places = [[{"kind": kind, "start": a, "end": b} for kind, a, b in found] for _, found in done]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([len(x) for x in places], pa.int64()), pa.array(places, spans)],
                    ["doc_id", "text", "n_replaced", "spans"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, n_replaced long, spans array<struct<kind:string,start:long,end:long>>")
