"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Numbers, dates and secrets are found by pattern and validated (Luhn, mod 97, calendar,
number plans); a valid value is numbered within its format's domain, the number is
permuted by a keyed Feistel network with cycle walking, and the new value is written
in the old one's format. A format is a set of strings that the reader takes alike, and
its pseudonyms stay inside it: for dates the order of the fields and their widths, for
secrets digits only, one case of hexadecimal, or the kind of each character. So with the key every
permutation can be undone. Equal values get equal pseudonyms in every document, also
where separators differ or, for e-mail names, upper and lower case; check digits stay
valid. Values that fail validation stay as they are, but for phone numbers written as
+1 (ddd) ddd-dddd, which are permuted among those outside the plan. Dates are read from
1900 to 2099; a slash date is month first unless its first field is over 12. Phone
numbers are those of the +1 plan; the length of an IBAN is not checked by country.

Finds that overlap: of two, the kind that comes first in ``PATTERNS`` stays, and of one kind the
one that begins first.

Defined cases: null text stays null with no finds; texts of any length are searched
whole; other columns pass through and the added ``pii`` column takes a suffix on a
clash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from datetime import date
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..plans.runtime import free_name

_ROUNDS = 8


class Feistel:
    """Keyed permutations of range(size) for any size, one per format name."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _mask(self, name: bytes, turn: int, half: int, bits: int) -> int:
        raw = hashlib.blake2b(name + b"|%d|%d" % (turn, half), key=self.key, digest_size=64).digest()
        return int.from_bytes(raw, "big") & ((1 << bits) - 1)

    def _pass(self, value: int, bits: int, name: bytes, back: bool) -> int:
        left, right = bits // 2, bits - bits // 2
        a, b = value >> right, value & ((1 << right) - 1)
        for turn in reversed(range(_ROUNDS)) if back else range(_ROUNDS):
            if turn % 2:
                b ^= self._mask(name, turn, a, right)
            else:
                a ^= self._mask(name, turn, b, left)
        return a << right | b

    def permute(self, value: int, size: int, name: str, back: bool = False) -> int:
        if not 0 <= value < size:
            raise ValueError("value outside its format")
        bits, tag = max(2, (size - 1).bit_length()), f"{name}|{size}".encode()
        value = self._pass(value, bits, tag, back)
        while value >= size:  # walk the cycle back into the domain
            value = self._pass(value, bits, tag, back)
        return value


def luhn_digit(digits: str) -> str:
    """The check digit that completes ``digits``."""
    total = sum(sum(divmod(int(c) * (2 - k % 2), 10)) for k, c in enumerate(reversed(digits)))
    return str(-total % 10)


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


@cache
def _days(day_width: int, month_width: int, late: bool) -> list[int]:
    """The days whose day and month fit the widths of their fields; ``late``: only those after the 12th."""
    first, last = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal()
    days = map(date.fromordinal, range(first, last))
    return [d.toordinal() for d in days if (day_width == 2 or d.day < 10) and (month_width == 2 or d.month < 10) and (d.day > 12 or not late)]


_HEX = re.compile("[0-9a-f]+")


class Pseudonyms:
    """Each method takes a found string and gives its pseudonym, or None if it is not valid."""

    def __init__(self, key: bytes, back: bool = False):
        self.feistel, self.back = Feistel(key), back

    def _turn(self, value: int, size: int, name: str) -> int:
        return self.feistel.permute(value, size, name, self.back)

    def _walk(self, text: str, turn: Callable[[str], str], inside: Callable[[str], bool]) -> str:
        """``turn`` until the text is in the format again, which keeps it a permutation of the format."""
        text = turn(text)
        while not inside(text):
            text = turn(text)
        return text

    def _spell(self, text: str, name: str) -> str:
        """Letters and digits permuted as one number; each stays of its kind and place."""
        kinds = [(c, *next(((lo, n) for lo, n in (("0", 10), ("a", 26), ("A", 26)) if 0 <= ord(c) - ord(lo) < n), (None, 1))) for c in text]
        size, value = 1, 0
        for c, lo, n in kinds:
            if lo:
                size, value = size * n, value * n + ord(c) - ord(lo)
        if size < 2:
            return text
        value, out = self._turn(value, size, f"{name}:{''.join(lo or c for c, lo, _ in kinds)}"), []
        for c, lo, n in reversed(kinds):
            if lo:
                value, k = divmod(value, n)
                c = chr(ord(lo) + k)
            out.append(c)
        return "".join(reversed(out))

    def _hex(self, text: str, name: str) -> str:
        return format(self._turn(int(text, 16), 16 ** len(text), name), f"0{len(text)}x")

    def email(self, s: str) -> str | None:
        local, _, host = s.rpartition("@")
        if len(local) > 64 or ".." in s or local[0] == "." or local[-1] == ".":
            return None
        new = self._spell(local.lower(), "email")
        return "".join(n.upper() if c.isupper() else n for c, n in zip(local, new, strict=True)) + f"@{host}"

    def card(self, s: str) -> str | None:
        digits = re.sub(r"\D", "", s)
        if not 13 <= len(digits) <= 19 or len(set(digits)) == 1 or luhn_digit(digits[:-1]) != digits[-1]:
            return None
        issuer, account = digits[:6], digits[6:-1]
        turn = lambda x: str(self._turn(int(x), 10 ** len(account), f"card:{issuer}")).zfill(len(account))
        whole = lambda x: issuer + x + luhn_digit(issuer + x)
        return _refill(s, whole(self._walk(account, turn, lambda x: len(set(whole(x))) > 1)))

    def phone(self, s: str) -> str | None:
        digits = re.sub(r"\D", "", s)
        country, national = digits[:-10], digits[-10:]
        if len(national) != 10 or country not in ("", "1"):
            return None
        outside = lambda x: x[0] in "01" or x[3] in "01"
        if outside(national):
            if not s.startswith("+1") or "(" not in s:
                return None
            return _refill(s, country + self._walk(national, lambda x: f"{self._turn(int(x), 10**10, 'phone-any'):010d}", outside))
        value = ((int(national[:3]) - 200) * 800 + int(national[3:6]) - 200) * 10_000 + int(national[6:])
        rest, line = divmod(self._turn(value, 800 * 800 * 10_000, "phone"), 10_000)
        area, exchange = divmod(rest, 800)
        return _refill(s, f"{country}{area + 200}{exchange + 200}{line:04d}")

    def ssn(self, s: str) -> str | None:
        area, group, serial = (int(x) for x in s.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        rest, serial = divmod(self._turn(value, 898 * 99 * 9999, "ssn"), 9999)
        area, group = divmod(rest, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def ip(self, s: str) -> str | None:
        parts = [int(x) for x in s.split(".")]
        if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in s.split(".")):
            return None
        value = self._turn(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
        return ".".join(map(str, value.to_bytes(4, "big")))

    def iban(self, s: str) -> str | None:
        plain = s.replace(" ", "")
        number = lambda x: int("".join(str(int(c, 36)) for c in x))
        if not 15 <= len(plain) <= 34 or not 2 <= int(plain[2:4]) <= 98 or number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        account = self._spell(plain[4:], f"iban:{plain[:2]}")
        new = iter(f"{plain[:2]}{98 - number(account + plain[:2] + '00') % 97:02d}{account}")
        return "".join(c if c == " " else next(new) for c in s)

    def date(self, s: str) -> str | None:
        a, b, c = re.split(r"[-/.]", s)
        order = "ymd" if len(a) == 4 else "mdy" if "/" in s and int(a) <= 12 else "dmy"
        year, month, day = {"ymd": (a, b, c), "mdy": (c, a, b), "dmy": (c, b, a)}[order]
        try:
            at = date(int(year), int(month), int(day)).toordinal()
        except ValueError:
            return None
        late = "/" in s and order == "dmy"
        days = _days(len(day), len(month), late)
        place = bisect_left(days, at)
        if place == len(days) or days[place] != at:
            return None
        new = date.fromordinal(days[self._turn(place, len(days), f"date:{len(day)}{len(month)}{late:d}")])
        text = {"y": f"{new.year:04d}", "m": f"{new.month:0{len(month)}d}", "d": f"{new.day:0{len(day)}d}"}
        return s[4 if order == "ymd" else -5].join(text[k] for k in order)

    def key(self, s: str) -> str | None:
        size, value = 36 ** len(s[4:]), int(s[4:], 36)
        value, out = self._turn(value, size, "key"), ""
        for _ in s[4:]:
            value, k = divmod(value, 36)
            out = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[k] + out
        return s[:4] + out

    def secret(self, s: str) -> str | None:
        head, value = re.fullmatch(r"(?s)(.*?[=:]\s*[\"']?)([^\s\"']+)", s).groups()
        return head + self._secret(value)

    def _secret(self, value: str) -> str:
        spell = lambda x: self._spell(x, "secret")
        if value.isdecimal() and value.isascii():
            return spell(value)
        plain = lambda x: not _HEX.fullmatch(x) and not (x == x.upper() and _HEX.fullmatch(x.lower()))
        if plain(value):
            return self._walk(value, spell, plain)
        new = self._walk(value.lower(), lambda x: self._hex(x, "secret"), lambda x: not x.isdecimal())
        return new.upper() if value.isupper() else new


#: Kind and pattern, in order of precedence. Dates and numbers never start or end inside a longer number or word.
PATTERNS = [
    ("email", r"(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,24}(?![\w-])"),
    ("secret", r"(?i:(?<![a-z])(?:password|passwd|pwd|token|secret|api[_-]?key))\s*+[=:]\s*+(?:\"[^\s\"']{6,}+(?=\")|'[^\s\"']{6,}+(?=')|[^\s\"']{6,}+)"),
    ("key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("phone", r"(?<![\w+(.-])\+1[ .-]?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![\w-])|(?<![\w+(.-])(?:\+?1[ .-]?)?\([2-9][0-9]{2}\) ?[0-9]{3}[ .-][0-9]{4}(?![\w-])|(?<![\w+(.-])(?:\+?1[ .-])?[2-9][0-9]{2}([ .-])[0-9]{3}\1[0-9]{4}(?![\w-])"),
    ("card", r"(?<![\w.-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}(?:\1[0-9]{4}){1,2}\1[0-9]{1,4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![\w-])"),
    ("ssn", r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    ("ip", r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[\w])"),
    ("date", r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([/.])[0-9]{1,2}\1[0-9]{4})(?![\w/-])"),
]


_DIGIT = re.compile("[0-9]")
#: What a text must hold for a kind to occur; the other kinds need a digit.
_HINTS = {"email": "@", "secret": "=:", "key": ("AKIA", "ASIA")}
_SINGLE = [(kind, re.compile(pattern)) for kind, pattern in PATTERNS]

def replacer(key: bytes, back: bool = False) -> Callable[[str], tuple[str, list[tuple[str, int, int]]]]:
    """text -> (text with pseudonyms, finds as (kind, start, end) in the new text)."""
    names = Pseudonyms(key, back)

    def replace(text: str) -> tuple[str, list[tuple[str, int, int]]]:
        found: list[tuple[int, int, str, str]] = []
        # each kind on its own, so that a value that is not valid hides no other
        digits = _DIGIT.search(text) is not None
        for kind, pattern in _SINGLE:
            if not (digits if kind not in _HINTS else any(h in text for h in _HINTS[kind])):
                continue
            for m in pattern.finditer(text):
                new = getattr(names, kind)(m.group())
                if new is not None:
                    found.append((m.start(), m.end(), kind, new))
        if not found:
            return text, []
        rank = {kind: k for k, (kind, _) in enumerate(PATTERNS)}
        taken: list[tuple[int, int, str, str]] = []
        for f in sorted(found, key=lambda f: (f[0], rank[f[2]], -f[1])):
            if taken and f[0] < taken[-1][1]:
                if rank[f[2]] < rank[taken[-1][2]]:
                    taken[-1] = f
                continue
            taken.append(f)
        parts, finds, at, length = [], [], 0, 0
        for start, end, kind, new in taken:
            parts += [text[at:start], new]
            length += start - at
            finds.append((kind, length, length + len(new)))
            length += len(new)
            at = end
        return "".join([*parts, text[at:]]), finds

    return replace


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text", keep: list[str] | None = None, back: bool = False) -> DataFrame:
    """``docs`` (or its ``keep`` columns) with pseudonyms in ``text`` and ``pii``: (kind, start, end) of each."""
    kept = list(dict.fromkeys([*(docs.columns if keep is None else keep), text]))
    name = free_name("pii", docs.columns)
    find = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replace = replacer(key, back)
        for batch in batches:
            place = batch.schema.get_field_index(text)
            column = batch.column(place)
            for at in range(0, batch.num_rows, 500):
                done = [(None, []) if t is None else replace(t) for t in column.slice(at, 500).to_pylist()]
                part = batch.slice(at, 500)
                columns = [pa.array([d[0] for d in done], pa.string()) if k == place else part.column(k) for k in range(part.num_columns)]
                finds = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in d[1]] for d in done], found_type)
                yield pa.RecordBatch.from_arrays([*columns, finds], names=[*batch.schema.names, name])

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(name, T.ArrayType(find))])
    return docs.select(*kept).mapInArrow(run, schema)
