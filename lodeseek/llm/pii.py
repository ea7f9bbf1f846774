"""Format-preserving pseudonyms for personal data.

One scan per text finds numbers, dates, addresses and secrets; what validates (Luhn, mod 97, calendar, octets, lengths)
is replaced by its image under a keyed permutation of all values of the same format, so that equal values get equal
pseudonyms in every document, whatever separators they are written with, and the key's holder can invert them. Numbers
that don't validate stay as they are. Where a card's or an IBAN's longest stretch doesn't, its parts between separators are
tried, so that an expiry date, a security code or a word beside it hides neither. A pseudonym that would validate together
with what stands beside it gives way to its own pseudonym; so such a value, beside digits that fit by chance, has another one.

The permutation is a Feistel network on a two-digit mixed radix, walked along its cycle where the format's values aren't
the whole range. It is conjugated with a step by one: p(x) = E^-1(E(x) + 1). So no value is its own pseudonym, unless
its format has only one.

Kinds: card (check digit recomputed), iban (country kept, check digits recomputed), ssn, phone (country code kept), ipv4,
date (years 1900 to 2099, order, separators and widths kept, a time may follow), email (letters and digits before the @,
other letters than ASCII's within their kind and their 256 neighbours), secret (letters and digits assigned to a name such
as token or password). A value that has no other of its format isn't reported.

Defined results: a null text stays null and an empty one empty, with nothing found; texts of any length are scanned
whole; repeated rows get the same result; an empty table stays empty; of overlapping matches the leftmost counts, and at
one place the kind first in KINDS. Columns keep their names and order; a spans_col that docs has already raises.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import free_name, smaller_batches, worker_cache

ROUNDS = 8
KINDS = {
    "email": r"(?<![\w.%+\u0300-\u036f-])[\w.%+\u0300-\u036f-]++@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}",
    "secret": r"(?i:\b(?:api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|auth[_-]?token|token|passw(?:or)?d)\b[\"']?\s*[:=]\s*[\"']?)(?P<secret_value>[A-Za-z0-9+/_=.-]{12,})",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ipv4": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w+(])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "date": r"(?<![\w./-])(?:(?:19|20)\d\d([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2(?:19|20)\d\d)(?:(?=T\d\d(?!\d))|(?=T\d{4}(?!\d))|(?!\w|[./-]\d))",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?!\w|[.-]\d)",
}
_each = {k: re.compile(p) for k, p in KINDS.items()}
#: Whatever is replaced holds a digit or an @; a secret has two digits at least.
_hint = re.compile("[0-9@]")


class Permutation:
    """A keyed permutation of range(size), without fixed points for a size of 2 or more."""

    def __init__(self, key: bytes, kind: str, size: int):
        self.size = size
        self.left = max(1, isqrt(size - 1) + 1) if size > 1 else 1
        self.right = -(-size // self.left)
        self.key = hashlib.blake2b(f"{kind}:{size}".encode(), key=key[:64], digest_size=32).digest()

    def _f(self, i: int, half: int) -> int:
        data = i.to_bytes(1, "big") + half.to_bytes((half.bit_length() + 8) // 8, "big")
        n = max(16, (max(self.left, self.right).bit_length() + 7) // 8 + 8)
        out = b"".join(hashlib.blake2b(data, key=self.key, digest_size=64, salt=k.to_bytes(8, "big")).digest() for k in range(-(-n // 64)))
        return int.from_bytes(out[:n], "big")

    def _once(self, x: int, back: bool) -> int:
        a, b = divmod(x, self.right)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                a = (a + sign * self._f(i, b)) % self.left
            else:
                b = (b + sign * self._f(i, a)) % self.right
        return a * self.right + b

    def _walk(self, x: int, back: bool) -> int:
        while (x := self._once(x, back)) >= self.size:
            pass
        return x

    def apply(self, x: int) -> int:
        return self._walk((self._walk(x, False) + 1) % self.size, True)

    def invert(self, x: int) -> int:
        return self._walk((self._walk(x, False) - 1) % self.size, True)


def luhn(digits: str) -> int:
    """The check digit that follows digits."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return -total % 10


def relay(form: str, filled: str) -> str:
    """form with its letters and digits replaced by filled's, in order; the case of letters is form's."""
    it = iter(filled)
    return "".join((c if not c.isalpha() else c.upper() if old.isupper() else c.lower()) if old.isalnum() and old.isascii() and (c := next(it)) else old for old in form)


@lru_cache(4096)
def alphabet(c: str) -> tuple[str, str]:
    """The letters or digits that c may become, in lower case where they have one, and their name."""
    if c.isascii():
        return ("0123456789", "d") if c.isdigit() else ("abcdefghijklmnopqrstuvwxyz", "a")

    def folded(x: str) -> str:
        low = x.lower()
        return low if len(low) == 1 and low.upper() == x else x

    def cased(x: str) -> bool:
        return len(x.upper()) == 1 and x.upper() != x and x.upper().lower() == x

    low = folded(c)
    page, kind = ord(low) >> 8, unicodedata.category(low)
    near = [x for x in map(chr, range(page << 8, (page + 1) << 8)) if not x.isascii() and x.isalnum() and unicodedata.category(x) == kind and cased(x) == cased(low) and folded(x) == x]
    return "".join(near), f"{page:x}{kind}{cased(low)}"


def iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


class Pseudonyms:
    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = key, back
        self.step = lru_cache(100_000)(self._step)

    def _step(self, kind: str, size: int, x: int) -> int:
        p = Permutation(self.key, kind, size)
        return p.invert(x) if self.back else p.apply(x)

    def mapped(self, kind: str, chars: str) -> str:
        """Letters to letters and digits to digits of their own alphabets, by place; letters come out in lower case."""
        if not chars.isascii():
            chars = "".join(c.lower() if len(c.lower()) == 1 and c.lower().upper() == c else c for c in chars)
        size, x, own = 1, 0, [alphabet(c) for c in chars]
        for c, (letters, _) in zip(chars, own):
            size, x = size * len(letters), x * len(letters) + letters.index(c if c in letters else c.lower())
        if size == 1:
            return chars
        shape = "".join(name for _, name in own)
        x, out = self.step(f"{kind}:{shape}", size, x), []
        for letters, _ in reversed(own):
            x, d = divmod(x, len(letters))
            out.append(letters[d])
        return "".join(reversed(out))

    @staticmethod
    def is_card(text: str) -> bool:
        digits = re.sub(r"\D", "", text)
        return int(digits[-1]) == luhn(digits[:-1]) and digits.strip("0") != ""

    @staticmethod
    def is_iban(text: str) -> bool:
        plain = text.replace(" ", "")
        return 15 <= len(plain) <= 34 and iban_number(plain[4:] + plain[:4]) % 97 == 1

    def card(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if not self.is_card(text):
            return None
        new = self.mapped("card", digits[:-1])
        return relay(text, new + str(luhn(new)))

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        if not self.is_iban(text):
            return None
        new = self.mapped("iban", plain[4:])
        check = 98 - iban_number(new.upper() + plain[:2] + "00") % 97
        return relay(text, f"{plain[:2]}{check:02d}{new}")

    def walk(self, kind: str, size: int, x: int, good: Callable[[int], bool]) -> int:
        y = self.step(kind, size, x)
        while not good(y):
            y = self.step(kind, size, y)
        return y

    def ssn(self, text: str) -> str | None:
        def good(x: int) -> bool:
            area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
            return area not in (0, 666) and area < 900 and group > 0 and serial > 0

        x = int(text.replace("-", ""))
        return relay(text, f"{self.walk('ssn', 10**9, x, good):09d}") if good(x) else None

    def ipv4(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        y = self.step("ipv4", 1 << 32, int.from_bytes(bytes(map(int, parts)), "big"))
        return ".".join(map(str, y.to_bytes(4, "big")))

    def phone(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if not (8 if text[0] == "+" else 10) <= len(digits) <= 15:
            return None
        country = len(re.match(r"\+(\d{1,3})(?=[ .(-])|\+(\d)|()", text)[0].lstrip("+"))
        return relay(text, digits[:country] + self.mapped("phone", digits[country:]))

    def date(self, text: str) -> str | None:
        a, b, c = re.split(r"\D", text)
        first = datetime.date(1900, 1, 1).toordinal()
        year_first = len(a) == 4

        def read(d: str, m: str, y: str) -> int | None:
            try:
                return datetime.date(int(y), int(m), int(d)).toordinal() - first
            except ValueError:
                return None

        x = read(c, b, a) if year_first else read(a, b, c)
        swapped = x is None and not year_first
        if swapped:
            x = read(b, a, c)
        if x is None:
            return None

        def shown(y: int) -> list[str]:
            d = datetime.date.fromordinal(first + y)
            parts = (d.year, d.month, d.day) if year_first else (d.month, d.day, d.year) if swapped else (d.day, d.month, d.year)
            return [f"{p:0{len(old)}d}" for p, old in zip(parts, (a, b, c))]

        def good(y: int) -> bool:
            parts = shown(y)
            return [len(p) for p in parts] == [len(a), len(b), len(c)] and (not swapped or int(parts[1]) > 12)

        form = f"date:{year_first}:{swapped}:{len(a)}:{len(b)}:{len(c)}"
        return relay(text, "".join(shown(self.walk(form, datetime.date(2100, 1, 1).toordinal() - first, x, good))))

    def email(self, text: str) -> str | None:
        name, _, domain = text.rpartition("@")
        chars = "".join(c for c in name if c.isalnum())
        it = iter(self.mapped("email", chars))
        new = "".join((new.upper() if old.isupper() else new) if old.isalnum() and (new := next(it)) else old for old in name)
        return f"{new}@{domain}" if new != name else None

    def secret(self, text: str) -> str | None:
        chars = "".join(c for c in text if c.isalnum() and c.isascii())
        if sum(map(str.isdigit, chars)) < 2 or len(chars) < 12:
            return None
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", chars):
            new = f"{self.step(f'hex:{len(chars)}', 16 ** len(chars), int(chars, 16)):0{len(chars)}x}"
            it = iter(new if chars == chars.lower() else new.upper())
            return "".join(next(it) if c.isalnum() and c.isascii() else c for c in text)
        return relay(text, self.mapped("secret", chars))

    def stretches(self, kind: str, line: str, upto: int = 0) -> Iterator[tuple[int, int]]:
        """Start and end of each valid card or IBAN from ``upto`` on: the longest stretch, or else its parts between
        separators, from the left and the longer one first; the search goes on behind a failed stretch's start. None
        begins or ends within what has another kind's form, or holds it."""
        pattern = _each[kind]
        forms = None
        while m := pattern.search(line, upto):
            at, end = m.span()
            cuts = [at, *(k + 1 for k in range(at, end) if line[k] in " -"), end + 1]
            starts = cuts[:-1] if kind == "card" else [at]
            parts = [(a, b - 1) for a in starts for b in reversed(cuts) if b > a]
            for a, b in [(at, end), *parts]:
                if forms is None:
                    forms = [m.span() for k in ("ssn", "date", "phone") for m in _each[k].finditer(line)]
                if any(x < a < y or x < b < y or (a <= x and y <= b) for x, y in forms):
                    continue
                if pattern.fullmatch(line[a:b]) and getattr(self, f"is_{kind}")(line[a:b]):
                    yield a, b
                    upto = b
                    break
            else:
                upto = at + 1

    def in_line(self, kind: str, line: str) -> Iterator[tuple[int, int, str]]:
        """Start, end and replacement of cards or IBANs. A pseudonym with which another stretch of the line would be valid
        is passed over for the next one, so that the way back finds the same stretches."""
        before = 0
        for at, end in self.stretches(kind, line):
            new = getattr(self, kind)(line[at:end])
            for _ in range(1000):
                if next(self.stretches(kind, line[:at] + new + line[end:], before), None) == (at, end):
                    break
                new = getattr(self, kind)(new)
            yield at, end, new
            before = end

    def matches(self, line: str) -> list[tuple[int, int, str, str]]:
        """Start, end, kind and replacement, without overlaps."""
        found = []
        for order, (kind, pattern) in enumerate(_each.items()):
            if kind in ("card", "iban"):
                found += [(at, order, end, kind, new) for at, end, new in self.in_line(kind, line)]
                continue
            for m in pattern.finditer(line):
                at, end = m.span("secret_value") if kind == "secret" else m.span()
                if (new := getattr(self, kind)(line[at:end])) is not None:
                    found.append((at, order, end, kind, new))
        out, upto = [], 0
        for at, _, end, kind, new in sorted(found):
            if at >= upto:
                out.append((at, end, kind, new))
                upto = end
        return out

    def replace(self, text: str) -> tuple[str, list[tuple[int, int, str]]]:
        """The text with pseudonyms, and the spans replaced in the old text. Only lines with a hint are looked into."""
        spans, out, done, at = [], [], 0, 0
        while hint := _hint.search(text, at):
            start = text.rfind("\n", 0, hint.start()) + 1
            end = text.find("\n", hint.start())
            end = len(text) if end < 0 else end
            for a, b, kind, new in self.matches(text[start:end]):
                out += [text[done : start + a], new]
                done = start + b
                spans.append((start + a, done, kind))
            at = end + 1
        return ("".join([*out, text[done:]]) if spans else text), spans


RESULT = "struct<text:string,spans:array<struct<start:long,end:long,kind:string>>>"
RESULT_ARROW = pa.struct([("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])))])


def pseudonymised(docs: DataFrame, key: bytes, text_col: str = "text", spans_col: str | None = None, back: bool = False) -> DataFrame:
    """docs with the text's personal data replaced; spans_col adds the spans (start, end, kind) in the old text."""

    if spans_col and spans_col.lower() in map(str.lower, docs.columns):
        raise ValueError(f"docs has a column {spans_col} already")

    def run(texts: pa.Array) -> pa.Array:
        worker_cache("none")
        names = Pseudonyms(key, back)
        out = []
        for text in texts.to_pylist():
            new, spans = names.replace(text) if text else (text, [])
            # Only changed texts travel back.
            out.append({"text": new if spans else None, "spans": [{"start": a, "end": b, "kind": k} for a, b, k in spans]})
        return pa.array(out, RESULT_ARROW)

    smaller_batches(docs.sparkSession)
    udf = F.arrow_udf(run, RESULT)
    own = free_name(docs, "_pii")
    rows = docs.withColumn(own, udf(F.col(text_col).cast("string")))
    columns = [F.coalesce(F.col(f"{own}.text"), F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*columns, *([F.col(f"{own}.spans").alias(spans_col)] if spans_col else []))


def counted(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{n}" for k, n in sorted(Counter(k for _, _, k in spans).items()))
