"""Format-preserving pseudonyms for personal data.

Numbers, dates, addresses and secrets are found by shape and validated (check digits,
calendar, octets). A value becomes an integer within its format, a keyed Feistel
network permutes the integers of that format, and the result is written back in the
same shape with its separators. The same value always gets the same pseudonym, in any
document and on any machine, so links stay; without the key it can't be undone.
"""

from __future__ import annotations

import datetime
import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_rows

ROUNDS = 10
#: Letters and digits up to which a value is permuted as one integer; longer ones place by place.
ONE_INTEGER = 64
#: Environment variable with the key.
KEY_VARIABLE = "FOLIOSPARK_PII_KEY"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

#: Shapes, the first that matches at a place counts. Letters of any script may stand around them.
SHAPES = {
    "email": r"(?<![\w.+-])[\w.+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "secret": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:sk|pk|ghp|gho|xox[abp])[-_][A-Za-z0-9_-]{16,}|(?<=[=:\"' ])(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "assigned": r"(?i:(?<![a-z])(?:api[_-]?key|access[_-]?key|secret|token|passwd|password|pwd|auth)\s?[=:]\s?[\"']?)(?P<value>[A-Za-z0-9+/_-]*[0-9][A-Za-z0-9+/_-]*)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9])(?<![0-9]\.)(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./](?:19|20)[0-9]{2})(?![0-9]|[./-][0-9])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9]{13,19}(?![0-9])|(?<![0-9])[0-9]{4}(?P<mark>[ -])[0-9]{4}(?P=mark)[0-9]{4}(?P=mark)[0-9]{1,7}(?![0-9])|(?<![0-9])3[47][0-9]{2}(?P<sign>[ -])[0-9]{6}(?P=sign)[0-9]{5}(?![0-9])",
}
_SHAPE = re.compile("|".join(f"(?P<{name}>{shape})" for name, shape in SHAPES.items()))
#: What a text with a valid value has: a digit or @, or a secret of letters only.
_HINT = re.compile("[0-9@]|AKIA|(?:sk|pk|ghp|gho|xox[abp])[-_]|[a-f]{32}|[A-F]{32}")


class Feistel:
    """A keyed permutation of the integers below n, for any n."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _stream(self, tweak: bytes, r: int, half: bytes, size: int) -> bytes:
        """``size`` keyed bytes that depend on the round and on all of ``half``, in time linear in both."""
        return hashlib.shake_256(self.key + hashlib.blake2b(tweak, digest_size=16).digest() + bytes([r]) + half).digest(size)

    def _round(self, tweak: bytes, r: int, half: int, bits: int) -> int:
        return int.from_bytes(self._stream(tweak, r, half.to_bytes(bits // 8 + 1, "big"), bits // 8 + 1), "big") & ((1 << bits) - 1)

    def permute(self, x: int, n: int, tweak: str, inverse: bool = False) -> int:
        """Halves of a power of four of at least n; values from n on are permuted again until one is below."""
        if n < 2:
            return x
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        own = tweak.encode() + b"/" + n.to_bytes(n.bit_length() // 8 + 1, "big")
        mask = (1 << bits) - 1
        while True:
            left, right = x >> bits, x & mask
            for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
                if inverse:
                    left, right = right ^ self._round(own, r, left, bits), left
                else:
                    left, right = right, left ^ self._round(own, r, right, bits)
            x = left << bits | right
            if x < n:
                return x

    def places(self, values: np.ndarray, sizes: np.ndarray, tweak: str, inverse: bool = False) -> np.ndarray:
        """A permutation of the tuples of integers below ``sizes``, two at least, in time linear in their number.

        A Feistel network on the two halves of the tuple, which adds to each place of one half a
        keyed number that depends on all of the other half.
        """
        own = f"{tweak}/places/{len(sizes)}".encode() + sizes.astype("u1").tobytes()
        middle = len(sizes) // 2
        halves, widths = [values[:middle].astype(np.uint64), values[middle:].astype(np.uint64)], [sizes[:middle].astype(np.uint64), sizes[middle:].astype(np.uint64)]
        for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            k = r % 2
            stream = np.frombuffer(self._stream(own, r, halves[1 - k].astype("u1").tobytes(), 8 * len(widths[k])), dtype="<u8") % widths[k]
            halves[k] = (halves[k] + (widths[k] - stream if inverse else stream)) % widths[k]
        return np.concatenate(halves)

    def characters(self, value: str, tweak: str, inverse: bool = False, kinds: tuple[str, ...] = (DIGITS, LOWER, UPPER)) -> str:
        """Digits become digits, letters letters of the same case; all else stays."""
        places = [(i, kind) for i, c in enumerate(value) for kind in kinds if c in kind]
        numbers = [kind.index(value[i]) for i, kind in places]
        if len(places) > ONE_INTEGER:
            numbers = self.places(np.array(numbers), np.array([len(kind) for _, kind in places]), tweak, inverse).tolist()
        else:
            x, n = 0, 1
            for number, (_, kind) in zip(numbers, places, strict=True):
                x, n = x * len(kind) + number, n * len(kind)
            x = self.permute(x, n, tweak, inverse)
            for at in reversed(range(len(places))):
                x, numbers[at] = divmod(x, len(places[at][1]))
        out = list(value)
        for number, (i, kind) in zip(numbers, places, strict=True):
            out[i] = kind[number]
        return "".join(out)


def luhn_digit(digits: str) -> str:
    """The check digit of a card number without its own."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in f"{rest}{country}00")
    return f"{98 - int(number) % 97:02d}"


def _refill(shape: str, characters: str) -> str:
    """``characters`` in the places of the letters and digits of ``shape``."""
    it = iter(characters)
    return "".join(next(it) if c.isalnum() else c for c in shape)


class Pseudonyms:
    def __init__(self, key: bytes):
        self.feistel = Feistel(key)

    def of(self, kind: str, value: str, inverse: bool = False) -> str | None:
        """The pseudonym of a value of this shape, or None if it isn't valid."""
        return getattr(self, f"_{kind}")(value, inverse)

    def _email(self, value, inverse):
        local, domain = value.rsplit("@", 1)
        return f"{self.feistel.characters(local, 'email ' + domain.lower(), inverse)}@{domain}"

    def _secret(self, value, inverse):
        head = re.match(r"AKIA|[a-z]+[-_](?=[A-Za-z0-9_-]{16})|", value)[0]
        if re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}", value):
            return self.feistel.characters(value, "hex", inverse, (DIGITS + (UPPER if value.isupper() else LOWER)[:6],))
        return head + self.feistel.characters(value[len(head) :], "secret", inverse)

    def _assigned(self, value, inverse):
        return self._secret(value, inverse) if len(value) >= 8 else None

    def _iban(self, value, inverse):
        bare = value.replace(" ", "")
        if not 15 <= len(bare) <= 34 or _iban_check(bare[:2], bare[4:]) != bare[2:4]:
            return None
        rest = self.feistel.characters(bare[4:], f"iban {bare[:2]}", inverse)
        return _refill(value, bare[:2] + _iban_check(bare[:2], rest) + rest)

    def _ip(self, value, inverse):
        parts = value.split(".")
        if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
            return None
        x = self.feistel.permute(int.from_bytes(map(int, parts), "big"), 1 << 32, "ip", inverse)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _date(self, value, inverse):
        mark = next(c for c in value if not c.isdigit())
        parts = value.split(mark)
        if len(parts) != 3:
            return None
        order = (0, 1, 2) if mark == "-" else (2, 1, 0)  # day first, but for American slashes that can't be
        if mark == "/" and int(parts[1]) > 12:
            order = (2, 0, 1)
        try:
            day = datetime.date(*(int(parts[i]) for i in order)).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        while True:  # within the days that are written with as many digits and read in the same order
            day = FIRST_DAY + self.feistel.permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date", inverse)
            date = datetime.date.fromordinal(day)
            by = (date.year, date.month, date.day)
            out = [""] * 3
            for place, i in zip(range(3), order, strict=True):
                out[i] = str(by[place]).zfill(len(parts[i]))
            if all(len(a) == len(b) for a, b in zip(out, parts, strict=True)) and (mark != "/" or (int(out[1]) > 12) == (order == (2, 0, 1))):
                return mark.join(out)

    def _phone(self, value, inverse):
        head = re.match(r"\+[0-9]{1,3}(?=[ .(-])|\+|", value)[0]  # the country code stays
        digits = re.sub("[^0-9]", "", value[len(head) :])
        if not 7 <= len(digits) <= 14:
            return None
        return head + _refill(value[len(head) :], self.feistel.characters(digits, f"phone {head}", inverse))

    def _ssn(self, value, inverse):
        def valid(x):
            return x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"

        digits = value.replace("-", "")
        if not valid(digits):
            return None
        while not valid(digits := self.feistel.characters(digits, "ssn", inverse)):
            pass
        return _refill(value, digits)

    def _card(self, value, inverse):
        digits = re.sub("[^0-9]", "", value)
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        body = self.feistel.characters(digits[:-1], "card", inverse)
        return _refill(value, body + luhn_digit(body))

    def text(self, text: str, inverse: bool = False) -> tuple[str, list[str]]:
        """(the text with pseudonyms, the kinds of the values replaced, in order)."""
        if not _HINT.search(text):
            return text, []
        out, kinds, end, at = [], [], 0, 0
        while found := _SHAPE.search(text, at):
            kind = next(name for name in SHAPES if found[name] is not None)
            start, stop = found.span("value") if kind == "assigned" else found.span()
            new = self.of(kind, text[start:stop], inverse)
            if new is None:
                at = found.start() + 1  # a valid value may begin within
                continue
            out += [text[end:start], new]
            end = at = stop
            kinds.append("secret" if kind == "assigned" else kind)
        return "".join([*out, text[end:]]), kinds


@lru_cache(maxsize=4)
def pseudonyms(key: bytes) -> Pseudonyms:
    return Pseudonyms(key)


def pseudonymised(docs: DataFrame, key: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_replaced, kinds), a row for each row of ``docs``.

    text has each valid value replaced; kinds lists their kinds in order. Null text
    stays null, with nothing replaced. Texts without such values are unchanged. Null
    ids and repeated rows are rows like any other. No rows: no rows. Texts and values of
    any length are taken whole, in time linear in it; other columns play no part.
    ``key``: else from the environment; without either, an error.
    """
    key = key or os.environ.get(KEY_VARIABLE, "").encode()
    if not key:
        raise ValueError(f"give a key, or set {KEY_VARIABLE}")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = pseudonyms(key)
        found = [(None, []) if t is None else own.text(t) for t in batch.column(1).to_pylist()]
        texts, kinds = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(k) for k in kinds], pa.int64()), pa.array(kinds, pa.list_(pa.string()))], names=["doc_id", "text", "n_replaced", "kinds"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(arrow_rows(run, text=1), f"doc_id {dict(rows.dtypes)['doc_id']}, text string, n_replaced long, kinds array<string>")
