"""Format-preserving pseudonyms: validated numbers, dates and addresses, moved within their format by keyed Feistel rounds."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from datetime import date
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame

from foldsmith.llm.common import map_batches, slices

KINDS = ("email", "phone", "card", "iban", "ssn", "ip", "ipv6", "date")
ROUNDS = 8
FIRST_DAY, SHORT_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2000, 1, 1).toordinal(), date(2099, 12, 31).toordinal()

NEEDLE = re.compile(r"[0-9@]")
PATTERNS = {
    "email": r"\w(?:[\w.+%-]*\w)?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}[0-9]{2}[a-z0-9]{11,30})(?![A-Za-z0-9])",
    "date": r"(?<![\w.-])(?<![0-9]/)(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}"
            r"|[0-9]{1,2}/[0-9]{1,2}/(?:[0-9]{4}|[0-9]{2}))(?!(?!T[0-9])[\w-]|[./][0-9])",
    "ip": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])",
    "ipv6": r"(?<![\w:])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{3,39}(?![\w:])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "card": r"(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"
             r"|(?<![0-9] )00[1-9][0-9]{0,2}(?:[ .-][0-9]{2,8}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}(?P<gap>[ .-])[0-9]{3}(?P=gap)[0-9]{4})(?!\w)",
}
FOUND = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS.items()))
# letters move among those of their own kind
CLASSES = {"0": "0123456789", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "a": "abcdefghijklmnopqrstuvwxyz",
           "À": "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xDF)])), "à": "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))}
CLASS_OF = {c: (kind, i) for kind, chars in CLASSES.items() for i, c in enumerate(chars)}
# what may stand between the groups of a value whose pattern can run on into what follows it
BETWEEN = {"iban": " ", "card": " -", "phone": " .-"}
ALONE = {kind: re.compile(PATTERNS[kind]) for kind in BETWEEN}


def feistel(value: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of range(size): balanced Feistel rounds over the next even power of two, walked until inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    rounds = [blake2b(tweak, key=key, digest_size=16, salt=bytes([r])) for r in range(ROUNDS)]

    def mixed(r: int, right: int) -> int:
        state = rounds[r].copy()
        state.update(right.to_bytes(half // 8 + 1, "little"))
        return int.from_bytes(blake2b(state.digest(), digest_size=half // 8 + 1).digest(), "little") & mask

    while True:
        left, right = value >> half, value & mask
        if back:
            for r in reversed(range(ROUNDS)):
                left, right = right ^ mixed(r, left), left
        else:
            for r in range(ROUNDS):
                left, right = right, left ^ mixed(r, right)
        value = left << half | right
        if value < size:
            return value


def moved(value: int, size: int, key: bytes, tweak: str) -> int:
    """One step along a keyed cycle through range(size): a permutation that leaves no value in place (if size > 1)."""
    tag = tweak.encode()
    return feistel((feistel(value, size, key, tag) + 1) % size, size, key, tag, back=True)


def luhn_ok(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _classes(text: str, key: bytes, tweak: str) -> str:
    """Digits, capitals and small letters, ASCII's and Latin-1's, moved within their classes; all else stays."""
    known = [CLASS_OF.get(c) for c in text]
    value, size = 0, 1
    for at in known:
        if at:
            width = len(CLASSES[at[0]])
            value, size = value * width + at[1], size * width
    value = moved(value, size, key, tweak + "".join(at[0] if at else c for c, at in zip(text, known)))
    out = []
    for c, at in zip(reversed(text), reversed(known)):
        if at:
            value, rest = divmod(value, len(CLASSES[at[0]]))
            c = CLASSES[at[0]][rest]
        out.append(c)
    return "".join(reversed(out))


def _fill(shape: str, chars: str) -> str:
    """``chars`` in place of the letters and digits of ``shape``, separators kept."""
    rest = iter(chars)
    return "".join(next(rest) if c.isalnum() else c for c in shape)


def _card(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not luhn_ok(digits) or not int(digits):
        return None
    body = moved(int(digits[:-1]), 10 ** (len(digits) - 1), key, f"card{len(digits)}")
    body = str(body).zfill(len(digits) - 1)
    return _fill(text, body + next(c for c in "0123456789" if luhn_ok(body + c)))


def _iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "").upper()
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _classes(plain[4:], key, "iban" + plain[:2])
    new = _fill(text, f"{plain[:2]}{98 - number(body + plain[:2] + '00') % 97:02d}{body}")
    return new.lower() if text.islower() else new


def _ssn(text: str, key: bytes) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    rank = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    rank, serial = divmod(moved(rank, 898 * 99 * 9999, key, "ssn"), 9999)
    area, group = divmod(rank, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(text: str, key: bytes) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255:
        return None
    return ".".join(map(str, moved(int.from_bytes(bytes(octets), "big"), 1 << 32, key, "ip").to_bytes(4, "big")))


def _ipv6(text: str, key: bytes) -> str | None:
    try:
        value = int(ipaddress.IPv6Address(text))
    except ValueError:
        return None
    return str(ipaddress.IPv6Address(moved(value, 1 << 128, key, "ipv6"))) if value > 1 else None


def _date(text: str, key: bytes) -> str | None:
    parts = re.split(r"[-./]", text)
    order = "ymd" if len(parts[0]) == 4 else {".": "dmy", "/": "mdy"}[re.search(r"[./]", text)[0]]
    if order == "mdy" and int(parts[0]) > 12:
        order = "dmy"
    fields, short = dict(zip(order, map(int, parts))), order != "ymd" and len(parts[2]) == 2
    try:
        day = date(fields["y"] + 2000 * short, fields["m"], fields["d"]).toordinal()
    except ValueError:
        return None
    first = SHORT_DAY if short else FIRST_DAY
    if not first <= day <= LAST_DAY:
        return None
    new = date.fromordinal(first + moved(day - first, LAST_DAY - first + 1, key, "short date" if short else "date"))
    values = {"y": new.year % 100 if short else new.year, "m": new.month, "d": new.day}
    wide = min(map(len, parts[:2])) == 2 or order == "ymd"
    if order == "dmy" and "/" in text and new.day <= 12:
        order = "mdy"
    return re.search(r"[-./]", text)[0].join(str(values[f]).zfill(2 if wide or f == "y" else 1) for f in order)


def _phone(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 7 <= len(digits) <= 15:
        return None
    code = re.match(r"(?:\+|00)[0-9]{1,3}(?=\D)", text)
    head = text[:code.end()] if code else "+" if text[0] == "+" else ""
    return head + _classes(text[len(head):], key, "phone" + head)


def _email(text: str, key: bytes) -> str | None:
    name, _, domain = text.rpartition("@")
    return f"{_classes(name, key, 'email' + domain.lower())}@{domain}"


RULES = {"email": _email, "phone": _phone, "card": _card, "iban": _iban, "ssn": _ssn, "ip": _ip, "ipv6": _ipv6, "date": _date}


@lru_cache(maxsize=1 << 16)
def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """The value's pseudonym, or None if it fails its kind's validation."""
    return RULES[kind](value, key)


def replace(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with every valid value replaced, and (kind, start, end) of each in the new text."""
    if not NEEDLE.search(text):
        return text, []
    out, spans, at, end = [], [], 0, 0
    found = FOUND.search(text)
    while found:
        kind = next(k for k in PATTERNS if found[k] is not None)
        new, stop = pseudonym(kind, found[0], key), found.end()
        if new is None and kind in BETWEEN:
            kind, new, stop = _shorter(text, found, key)
        if new is None:
            found = FOUND.search(text, _next(text, found))
            continue
        out += [text[end:found.start()], new]
        at += found.start() - end
        spans.append((kind, at, at + len(new)))
        at += len(new)
        end = stop
        found = FOUND.search(text, end)
    return "".join([*out, text[end:]]), spans


def _reading(kind: str, text: str, start: int, key: bytes) -> tuple[str | None, int]:
    """Pseudonym and end of the longest valid value at ``start``: its whole match, or that without its last groups."""
    whole = ALONE[kind].match(text, start)
    if whole:
        if new := pseudonym(kind, whole[0], key):
            return new, whole.end()
        for stop in range(whole.end() - 1, start, -1):
            if text[stop] in BETWEEN[kind] and ALONE[kind].fullmatch(text, start, stop) and (new := pseudonym(kind, text[start:stop], key)):
                return new, stop
    return None, start


def _shorter(text: str, found: re.Match, key: bytes) -> tuple[str, str | None, int]:
    """(kind, pseudonym, end) of a valid value at the start of a match that failed, which may have run on into what follows it.

    A check digit also fits by chance, so a shorter value gives way to a longer one that starts at a later group of it. Digits
    that are no card number may begin with a phone number.
    """
    kind, start = next(k for k in PATTERNS if found[k] is not None), found.start()
    new, stop = _reading(kind, text, start, key)
    length = lambda a, b: sum(map(str.isalnum, text[a:b]))
    for at in range(start + 1, stop):
        if text[at] in BETWEEN[kind]:
            other, end = _reading(kind, text, at + 1, key)
            if other and length(at + 1, end) > length(start, stop):
                new = None
                break
    if new is None and kind == "card":
        kind = "phone"
        new, stop = _reading(kind, text, start, key)
    return kind, new, stop


def _next(text: str, found: re.Match) -> int:
    """Where to go on after a value that failed: behind its first run of digits and letters."""
    at = found.start() + 1
    while at < found.end() and text[at].isalnum():
        at += 1
    return at


def pseudonymize(documents: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, spans) per row of ``documents``: texts with personal values replaced, and where they are now.

    Kinds: e-mail addresses (the name changes, the domain stays), phone numbers (the country code stays), card numbers (Luhn), IBANs
    (mod 97, in capitals or all in small letters), social security numbers, IPv4 and IPv6 addresses and calendar dates from 1900 to 2099,
    also with a time behind them, and of two-digit years, which are those from 2000. Values that fail their check
    stay; a card number, IBAN or phone number is also found with groups of digits or capitals right behind it, as an expiry date or
    a currency. A value is encoded as a number below its format's size, moved by a keyed Feistel permutation and written in the same format
    with check digits made anew, so it stays valid, keeps its separators, and equal values are equal in all documents
    under one key. No value keeps its place. A date between slashes that reads both ways is month first.

    Whole texts are searched, rows where they lie. Null text stays null with no spans; ids may be null or repeat; other columns
    are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for part in slices(batches):
            texts, spans = [], []
            for value in part.column(1).to_pylist():
                text, found = replace(value, key) if value else (value, [])
                texts.append(text)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(spans, kinds)],
                                             names=["doc_id", "text", "spans"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").transform(
        map_batches,
        run, f"doc_id {kind}, text string, spans array<struct<kind: string, start: int, end: int>>")
