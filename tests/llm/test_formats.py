"""Pseudonyms stay in their format and can be undone; finds against an independent reader."""

import random
import re
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framequery.llm import pii

KEY = b"a key"
there, back = pii.Pseudonyms(KEY), pii.Pseudonyms(KEY, back=True)
PATTERN = dict(pii.PATTERNS)


def _round(kind, text):
    new = getattr(there, kind)(text)
    assert new is not None and len(new) == len(text) or kind == "ip"
    assert re.fullmatch(PATTERN[kind], new), (kind, text, new)
    assert getattr(back, kind)(new) == text, (kind, text, new)
    return new


DAYS = st.dates(date(1900, 1, 1), date(2099, 12, 31))


@given(DAYS, st.sampled_from(["{y:04d}-{m:02d}-{d:02d}", "{m:02d}/{d:02d}/{y}", "{d:02d}.{m:02d}.{y}", "{m}/{d}/{y}", "{d}.{m}.{y}", "{d:02d}/{m:02d}/{y}", "{d}/{m:02d}/{y}", "{d}/{m}/{y}"]))
@settings(max_examples=400, deadline=None)
def test_dates(day, shape):
    text = shape.format(y=day.year, m=day.month, d=day.day)
    new = _round("date", text)
    a, b = (re.split(r"[-/.]", x) for x in (text, new))
    assert [len(x) for x in a] == [len(x) for x in b]
    if "/" in text:
        assert (int(a[0]) > 12) == (int(b[0]) > 12)  # read in the same order


@pytest.mark.parametrize("kind", ["date-iso", "date-late"])
def test_dates_are_permutations(kind):
    if kind == "date-late":
        texts = [f"{d:02d}/{m:02d}/{y}" for y in range(1990, 2000) for m in range(1, 13) for d in range(13, 29)]
    else:
        texts = [f"{y}-{m:02d}-{d:02d}" for y in range(1990, 2000) for m in range(1, 13) for d in range(1, 29)]
    assert len({there.date(t) for t in texts}) == len(texts)


def test_dates_that_are_none():
    assert all(there.date(t) is None for t in ("2023-02-30", "1/2/1899", "31/12/2100", "0/1/2000", "13/13/2000"))
    assert there.date("2023-02-28").split("-") == there.date("28.02.2023").split(".")[::-1]


@given(st.from_regex(r"[A-Za-z0-9](?:[A-Za-z0-9_+-]|\.(?=[a-z])){0,12}[a-z]@[a-z]{2,8}\.(com|org)", fullmatch=True))
@settings(max_examples=200, deadline=None)
def test_emails(text):
    new = _round("email", text)
    assert there.email(text.upper().rpartition("@")[0] + "@x.org").lower().rpartition("@")[0] == new.lower().rpartition("@")[0]


@given(st.text("0123456789", min_size=12, max_size=18))
@settings(max_examples=200, deadline=None)
def test_cards(digits):
    text = digits + pii.luhn_digit(digits)
    if len(set(text)) > 1:
        new = _round("card", text)
        assert new[:6] == text[:6] and pii.luhn_digit(new[:-1]) == new[-1]


@given(st.from_regex(r"[2-9][0-9]{2}-[2-9][0-9]{2}-[0-9]{4}|\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}|\([2-9][0-9]{2}\) [2-9][0-9]{2}-[0-9]{4}", fullmatch=True))
@settings(max_examples=200, deadline=None)
def test_phones(text):
    _round("phone", text)


@given(st.integers(1, 899).filter(lambda a: a != 666), st.integers(1, 99), st.integers(1, 9999))
def test_ssns(a, b, c):
    _round("ssn", f"{a:03d}-{b:02d}-{c:04d}")


@given(st.lists(st.integers(0, 255), min_size=4, max_size=4))
def test_ips(parts):
    _round("ip", ".".join(map(str, parts)))


@given(st.from_regex(r"(DE|GB|FR)[A-Z0-9]{4}[0-9]{8,16}", fullmatch=True), st.booleans())
@settings(deadline=None)
def test_ibans(text, spaced):
    country, account = text[:2], text[2:]
    check = 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97
    text = f"{country}{check:02d}{account}"
    _round("iban", " ".join(text[i : i + 4] for i in range(0, len(text), 4)) if spaced else text)


@given(st.from_regex(r"AKIA[A-Z0-9]{16}", fullmatch=True))
def test_keys(text):
    _round("key", text)


@given(st.one_of(st.from_regex(r"[0-9a-f]{6,20}|[0-9A-F]{6,20}|[0-9]{6,12}|[a-zA-Z0-9!-]{6,20}|[a-g]{6,7}", fullmatch=True)), st.sampled_from(["token = \"{}\"", "password={}", "API_KEY: '{}'"]))
@settings(max_examples=300, deadline=None)
def test_secrets(value, shape):
    text = shape.format(value)
    m = re.search(PATTERN["secret"], text)
    assert m and there.secret(m.group()) is not None
    assert back.secret(there.secret(m.group())) == m.group()


def test_finds_against_an_independent_reader():
    """Values planted between words: each is found once, at its place, and nothing else is."""
    rng = random.Random(8)
    digits = lambda n, first="123456789": rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(n - 1))

    def value():
        kind = rng.choice(["email", "card", "phone", "ssn", "ip", "date", "key", "secret"])
        if kind == "card":
            d = digits(15)
            d += pii.luhn_digit(d)
            return kind, rng.choice([d, "-".join(d[i : i + 4] for i in range(0, 16, 4))])
        return kind, {
            "email": f"u{digits(3)}@h{digits(2)}.example.com",
            "phone": f"+1 ({digits(3)}) {digits(3)}-{digits(4)}",
            "ssn": f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{digits(4)}",
            "ip": ".".join(str(rng.randrange(1, 256)) for _ in range(4)),
            "date": f"{rng.randrange(1950, 2050)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}",
            "key": "AKIA" + "".join(rng.choice("ABCDEFGH2345") for _ in range(16)),
            "secret": "token=" + "".join(rng.choice("0123456789abcdef") for _ in range(24)),
        }[kind]

    for _ in range(60):
        parts, want, at = [], [], 0
        for _ in range(rng.randrange(1, 12)):
            word = rng.choice(["plain", "Version 2.0", "10,000", "wörter", "3.14159", "1999"])
            kind, text = value()
            parts.append(f"{word} {text} ,")
            want.append((kind, at + len(word) + 1, at + len(word) + 1 + len(text)))
            at += len(parts[-1]) + 1
        text = "\n".join(parts)
        new, finds = pii.replacer(KEY)(text)
        shifted = [(k, e - s) for k, s, e in finds]
        assert [k for k, _ in shifted] == [k for k, _, _ in want]
        assert pii.replacer(KEY, back=True)(new)[0] == text
