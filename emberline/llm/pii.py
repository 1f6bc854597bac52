"""Pseudonyms of personal data by keyed permutation inside the value's own format.

Every recognised value is validated (Luhn for cards, ranges for addresses and dates, mod 97 for IBANs)
and replaced by the image of a keyed Feistel permutation of all values of its format. The permutation
depends only on key, kind and format, so equal values get equal pseudonyms in all documents, different
values get different ones, and who has the key can undo them. Card and IBAN check digits are computed
anew, so a pseudonym passes the same validation as the value it stands for. Digits are ASCII digits. What is
looked at for one value is bounded, so cost is linear in a text's length; an address with over 64 characters
before its @ isn't one.

Defined results: a null text stays null with no findings; an empty text stays empty; text without
findings is returned unchanged; repeated rows give repeated rows; other columns pass through, and a
column of the same name as one that is added here is replaced.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import secrets
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import fresh, ship

ROUNDS = 10

# What each kind of personal data looks like.
EMAIL = r"(?P<email>(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8})"
IPV4 = r"(?P<ip>(?<![\w.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9]))"
DATE = r"(?P<date>(?<![\w\-/.])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4})(?![\w\-/]|\.[0-9]))"
SSN = r"(?P<ssn>(?<![\w\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w\-]))"
PHONE = r"(?P<phone>(?<![\w])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?!\w))"
CARD = r"(?P<card>(?<![\w])[0-9](?:[ \-]?[0-9]){12,18}(?!\w))"
IBAN = r"(?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?!\w))"
SECRET = r"(?P<secret>(?<!\w)AKIA[A-Z0-9]{16}(?!\w)|(?<=password=)\w{6,}|(?<=\")(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?=\"))"
KINDS = ("email", "ip", "date", "ssn", "phone", "card", "iban", "secret")
FOUND = re.compile("|".join((EMAIL, SECRET, IPV4, DATE, SSN, PHONE, CARD, IBAN)))
#: Every value that FOUND finds holds one of these or is one.
MAYBE = re.compile(r"[0-9@]|password=|AKIA|\"[A-Fa-f]{32}")
#: Longer values are permuted in parts.
PART = 64
#: The session's setting of the key.
KEY = "spark.emberline.pseudonymKey"


class Feistel:
    """Keyed permutations of [0, n) for any n: a two-branch Feistel network over [0, a) x [0, b) with
    modular addition, a * b >= n, walked along its cycle until the image lies below n."""

    def __init__(self, key: str):
        self.key = hashlib.sha256(key.encode()).digest()

    def _round(self, i: int, tweak: str, half: int, modulus: int) -> int:
        size = (modulus.bit_length() + 7) // 8 + 8
        given = f"{i}|{tweak}|".encode() + half.to_bytes((half.bit_length() + 7) // 8, "big")
        parts = [hashlib.blake2b(given + bytes([k]) * (k > 0), key=self.key, digest_size=min(64, size - 64 * k)).digest() for k in range(-(-size // 64))]
        return int.from_bytes(b"".join(parts), "big") % modulus

    def permute(self, x: int, n: int, tweak: str) -> int:
        if n < 2:
            return x
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            left, right = divmod(x, b)
            for i in range(ROUNDS):
                if i % 2:
                    right = (right + self._round(i, tweak, left, b)) % b
                else:
                    left = (left + self._round(i, tweak, right, a)) % a
            x = left * b + right
            if x < n:
                return x

    def invert(self, x: int, n: int, tweak: str) -> int:
        if n < 2:
            return x
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            left, right = divmod(x, b)
            for i in reversed(range(ROUNDS)):
                if i % 2:
                    right = (right - self._round(i, tweak, left, b)) % b
                else:
                    left = (left - self._round(i, tweak, right, a)) % a
            x = left * b + right
            if x < n:
                return x


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _date(value: str) -> tuple[str, datetime.date | None]:
    """(format, date): year first, or day and month in the order that is valid, day first if both are."""
    for style in ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d.%m.%Y", "%m.%d.%Y"):
        try:
            return style, datetime.datetime.strptime(value, style).date()
        except ValueError:
            continue
    return "", None


#: Days that pseudonyms of dates are drawn from, as format-preserving as the dates themselves.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Pseudonyms:
    def __init__(self, key: str, undo: bool = False):
        f = Feistel(key)
        self.move = f.invert if undo else f.permute

    def characters(self, value: str, tweak: str, free: str = "") -> str:
        """Permutes letters among letters of their case and digits among digits; other characters stay."""
        if len(value) > PART:
            return "".join(self.characters(value[i : i + PART], f"{tweak}|{i}") for i in range(0, len(value), PART))
        radix = [26 if c.islower() else 26 if c.isupper() else 10 if c.isdigit() else 1 for c in value]
        first = [97 if c.islower() else 65 if c.isupper() else 48 if c.isdigit() else ord(c) for c in value]
        x, n = 0, 1
        for c, r, o in zip(value, radix, first):
            x, n = x * r + ord(c) - o, n * r
        y = self.move(x, n, f"{tweak}|{','.join(map(str, radix))}")
        out = []
        for r, o in zip(reversed(radix), reversed(first)):
            y, d = divmod(y, r)
            out.append(chr(o + d))
        return "".join(reversed(out))

    def digits(self, value: str, tweak: str, valid=lambda s: True) -> str:
        """Permutes the digits of value among those strings of equal length that are valid."""
        y = value
        while True:
            y = str(self.move(int(y), 10 ** len(y), f"{tweak}|{len(y)}")).zfill(len(y))
            if valid(y):
                return y

    @staticmethod
    def dress(value: str, digits: str) -> str:
        """value with its digits replaced in order."""
        rest = iter(digits)
        return "".join(next(rest) if c in "0123456789" else c for c in value)

    def of(self, kind: str, value: str) -> str | None:
        """The pseudonym, or None if value isn't valid for its kind."""
        bare = re.sub("[^0-9]", "", value)
        if kind == "email":
            local, _, domain = value.partition("@")
            if not local.isascii():
                return None
            return f"{self.characters(local, 'email|' + domain.lower())}@{domain}"
        if kind == "ip":
            octets = [int(x) for x in value.split(".")]
            if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
                return None
            y = self.move(int.from_bytes(bytes(octets), "big"), 1 << 32, "ip")
            return ".".join(map(str, y.to_bytes(4, "big")))
        if kind == "date":
            style, day = _date(value)
            if day is None or not FIRST_DAY <= day.toordinal() <= LAST_DAY:
                return None
            y = FIRST_DAY + self.move(day.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date")
            return datetime.date.fromordinal(y).strftime(style)
        if kind == "ssn":
            valid = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
            return self.dress(value, self.digits(bare, "ssn", valid)) if valid(bare) else None
        if kind == "phone":
            head, own = bare[:-10], bare[-10:]
            plain = lambda s: s[0] > "1" and s[3] > "1"
            return self.dress(value, head + self.digits(own, "phone", lambda s: plain(s) == plain(own)))
        if kind == "card":
            if not luhn(bare) or len(set(bare)) == 1:
                return None
            y = self.digits(bare[:-1], "card", lambda s: len(set(s)) > 1 and (s[0] == "0") == (bare[0] == "0"))
            return self.dress(value, y + next(c for c in "0123456789" if luhn(y + c)))
        if kind == "iban":
            if _mod97(value) != 1:
                return None
            body = self.characters(value[4:], "iban|" + value[:2])
            return f"{value[:2]}{98 - _mod97(value[:2] + '00' + body):02d}{body}"
        if kind == "secret":
            if value.startswith("AKIA"):
                return "AKIA" + self.characters(value[4:], "key")
            if len(value) >= 32 and re.fullmatch("[0-9a-f]+|[0-9A-F]+", value):
                y = f"{self.move(int(value, 16), 16 ** len(value), f'hex|{len(value)}'):0{len(value)}x}"
                return y.upper() if value != value.lower() else y
            return self.characters(value, "password") if value.isascii() else None
        raise ValueError(kind)

    def text(self, text: str) -> tuple[str, dict[str, int]]:
        found: dict[str, int] = {}

        def swap(m: re.Match) -> str:
            y = self.of(m.lastgroup, m.group())
            if y is None:
                return m.group()
            found[m.lastgroup] = found.get(m.lastgroup, 0) + 1
            return y

        return (FOUND.sub(swap, text), found) if MAYBE.search(text) else (text, found)


def key_of(spark: SparkSession) -> str:
    """The key that the session's setting KEY holds; without one, a random key of this application's, which nobody
    learns, so its pseudonyms are linked but can't be undone."""
    sc = spark.sparkContext
    if named := spark.conf.get(KEY, None):
        return named
    if not getattr(sc, "_emberline_key", None):
        sc._emberline_key = secrets.token_hex(32)
    return sc._emberline_key


def pseudonymize(docs: DataFrame, key: str | None = None, undo: bool = False) -> DataFrame:
    """docs with personal data in `text` replaced, and a column pii_n_<kind> (int) for each kind."""
    ship(docs.sparkSession)
    key = key or key_of(docs.sparkSession)
    kind = f"text string, {', '.join(f'pii_n_{k} int' for k in KINDS)}"

    @F.pandas_udf(kind)
    def replaced(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Pseudonyms(key, undo)
        for batch in column:
            rows = [(None, {}) if x is None else own.text(x) for x in batch]
            yield pd.DataFrame({"text": pd.Series([x for x, _ in rows], dtype=object)} | {f"pii_n_{k}": pd.Series([f.get(k, 0) for _, f in rows], dtype="int32") for k in KINDS})

    held = fresh(docs, "pii")
    out = docs.withColumn(held, replaced("text"))
    added = [f"pii_n_{k}" for k in KINDS]
    return out.select(*[F.col(f"{held}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in added], *[F.col(f"{held}.{c}").alias(c) for c in added])


def rewritten(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with the same columns, personal data in `text` replaced (n_chars, where it is kept, still
    holds, as a pseudonym is as long as its value except for addresses and dates, so it is computed anew)."""
    out = pseudonymize(docs, key).select(*[F.col(f"`{c}`") for c in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
