"""Every kind of pseudonym against a plain version of its network, value by value."""

import datetime
import hashlib
import random

from quadloom.llm import pii
from tests.llm.test_operators import mirror

KEY = "k"
ZERO = datetime.date(1900, 1, 1)


def pair(left, right, parts, kind):
    for i in range(8):
        digest = lambda other, i=i: int(hashlib.sha256("|".join([KEY, kind, str(i), "0", str(other)]).encode()).hexdigest()[:12], 16)
        if i % 2 == 0:
            left = (left + digest(right)) % parts[0]
        else:
            right = (right + digest(left)) % parts[1]
    return left, right


def plain_date(day, order):
    n = (day - ZERO).days
    if not 0 <= n < 270 * 270:
        return day.strftime(order)
    a, b = pair(n // 270, n % 270, (270, 270), "date")
    return (ZERO + datetime.timedelta(a * 270 + b)).strftime(order)


def plain_ssn(s):
    a, g, n = map(int, s.split("-"))
    if not 1 <= a <= 899 or a == 666 or g == 0 or n == 0:
        return s
    left, right = pair(a - 1 - (a > 666), (g - 1) * 9999 + n - 1, (898, 99 * 9999), "ssn")
    return f"{left + 1 + (left >= 665):03d}-{right // 9999 + 1:02d}-{right % 9999 + 1:04d}"


def plain_ipv4(s):
    o = [int(x) for x in s.split(".")]
    if max(o) > 255:
        return s
    a, b = pair(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), "ipv4")
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def refilled(shape, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def plain_phone(s):
    d = "".join(c for c in s if c.isdigit())
    if not 8 <= len(d) <= 15:
        return s
    kept = 0 if s[0] != "+" else 1 if s[1] in "17" else 2
    return refilled(s, d[:kept] + mirror(d[kept:], KEY, "phone"))


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def plain_iban(s):
    plain = s.replace(" ", "")
    country, rest = plain[:2], plain[4:]
    if mod97(rest + plain[:4]) != 1 or not 15 <= len(plain) <= 34:
        return s
    body = mirror(rest, KEY, "iban")
    it = iter(f"{country}{98 - mod97(body + country + '00'):02d}{body}")
    return "".join(c if c == " " else next(it) for c in s)


def valid_iban(rng):
    country, body = rng.choice(["DE", "GB", "FR", "BE"]), "".join(rng.choice("0123456789ABCXYZ") for _ in range(rng.choice([12, 16, 20])))
    plain = f"{country}{98 - mod97(body + country + '00'):02d}{body}"
    return " ".join(plain[i : i + 4] for i in range(0, len(plain), 4)) if rng.random() < 0.5 else plain


def test_each_kind(spark):
    rng = random.Random(8)
    cases = []
    for order in ("%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y", "%d-%m-%Y", "%m/%d/%Y"):
        for day in [ZERO, datetime.date(2099, 8, 4), datetime.date(2000, 2, 29), *[ZERO + datetime.timedelta(rng.randrange(270 * 270)) for _ in range(20)]]:
            cases.append((day.strftime(order), plain_date(day, order)))
    cases += [("2099-08-05", "2099-08-05"), ("1899-12-31", "1899-12-31"), ("2001-02-30", "2001-02-30")]
    # day/month/year only where month/day/year is not valid
    cases.append(("25/12/2001", plain_date(datetime.date(2001, 12, 25), "%d/%m/%Y")))
    for _ in range(40):
        s = f"{rng.randrange(0, 1000):03d}-{rng.randrange(0, 100):02d}-{rng.randrange(0, 10000):04d}"
        cases.append((s, plain_ssn(s)))
        s = ".".join(str(rng.randrange(0, 280)) for _ in range(4))
        cases.append((s, plain_ipv4(s)))
        s = rng.choice(["+1 (212) 555-{:04d}", "+49 30 1234{:04d}", "(212) 555-{:04d}", "212-555-{:04d}", "+7 495 123 {:04d}", "+358.40.123.{:04d}"]).format(rng.randrange(10000))
        cases.append((s, plain_phone(s)))
        s = valid_iban(rng)
        cases.append((s, plain_iban(s)))
    rows = [(i, f"value {s} end") for i, (s, _) in enumerate(cases)]
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    wrong = [(s, got[i], want) for i, (s, want) in enumerate(cases) if got[i] != f"value {want} end"]
    assert not wrong, wrong[:5]
    changed = sum(a != b for a, b in cases)
    assert changed > 180
