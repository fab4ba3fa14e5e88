"""PII: format-preserving Feistel pseudonyms, in DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: What may be private, by kind; the first alternative that matches at a position counts (fixed values).
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}|\d{2}-\d{2}-\d{4})(?![\d]|[./-]\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!-?\d)",
    "ipv4": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d]|[.-]\d)",
    "secret": r"(?<![A-Za-z0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,128}(?![A-Za-z0-9])",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
}
#: Cards are looked for in what the other kinds leave, in whole runs of digits, however long.
ANY = "|".join(f"(?:{p})" for name, p in PATTERNS.items() if name != "card")
DIGITS = r"(?<!\d)\d(?:[ -]?+\d){12,}+"

#: Days from 1900-01-01 that count as dates, as a product for a two-part Feistel network: until 2099-08-04.
DAY_PARTS = (270, 270)
#: US social security numbers: areas 001-899 without 666, groups 01-99 and serials 0001-9999.
SSN_PARTS = (898, 99 * 9999)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _digest(key: Column, kind: str, i: Column, size: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, F.lit(kind), i.cast("string"), size.cast("string"), F.lower(other.cast("string"))), 256)


def _chars(s: Column) -> Column:
    return F.split(s, "")


def _shift(half: Column, stream: Column, hexadecimal: bool) -> Column:
    """Each digit or letter moved within its class by a byte of the stream; other characters stay."""
    letters = 6 if hexadecimal else 26

    def moved(c: Column, i: Column) -> Column:
        k = F.conv(F.substr(stream, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        within = lambda base, n: F.char(F.pmod(F.ascii(c) - base + k, F.lit(n)) + base)
        return F.when(c.between("0", "9"), within(48, 10)).when(c.between("a", "z"), within(97, letters)).when(c.between("A", "Z"), within(65, letters)).otherwise(c)

    return F.array_join(F.transform(_chars(half), moved), "")


def permute_text(s: Column, key: Column, kind: str, hexadecimal: bool = False) -> Column:
    """Feistel network over the two halves of a text; a permutation of the texts of its format."""
    n = F.length(s)
    half = F.floor(n / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1, n).alias("r"))

    def step(acc: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, _shift(acc["l"], _digest(key, kind, i, n, acc["r"]), hexadecimal)).otherwise(acc["l"])
        right = F.when(i % 2 == 1, _shift(acc["r"], _digest(key, kind, i, n, acc["l"]), hexadecimal)).otherwise(acc["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(acc["l"], acc["r"]))


def permute_pair(left: Column, right: Column, parts: tuple[int, int], key: Column, kind: str) -> Column:
    """struct(l, r): Feistel network over Z_a x Z_b, so exact on any product and without cycle walking."""
    a, b = parts

    def step(acc: Column, i: Column) -> Column:
        mixed = lambda own, other, n: F.pmod(own + F.conv(F.substring(_digest(key, kind, i, F.lit(0), other), 1, 12), 16, 10).cast("long"), F.lit(n).cast("long"))
        return F.struct(F.when(i % 2 == 0, mixed(acc["l"], acc["r"], a)).otherwise(acc["l"]).alias("l"), F.when(i % 2 == 1, mixed(acc["r"], acc["l"], b)).otherwise(acc["r"]).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _refill(s: Column, digits: Column) -> Column:
    """s with its digits replaced, in order, by those given."""
    place = lambda i: F.length(_digits(F.substr(s, F.lit(1), i))) + 1
    return _let(digits, lambda d: F.array_join(F.transform(_chars(s), lambda c, i: F.when(c.between("0", "9"), F.substr(d, place(i), F.lit(1))).otherwise(c)), ""))


def _card(s: Column, key: Column) -> Column:
    def fresh(digits: Column) -> Column:
        body = permute_text(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
        check = lambda b: F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: F.call_function("luhn_check", F.concat(b, d.cast("string"))))[0]
        return F.when(F.call_function("luhn_check", digits), _refill(s, _let(body, lambda b: F.concat(b, check(b).cast("string")))))

    return _let(_digits(s), fresh)


def _mod97(s: Column) -> Column:
    number = F.array_join(F.transform(_chars(s), lambda c: F.when(c.between("A", "Z"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    return F.aggregate(F.filter(_chars(number), lambda c: c != ""), F.lit(0), lambda acc, c: F.pmod(acc * 10 + c.cast("int"), F.lit(97)))


def _iban(s: Column, key: Column) -> Column:
    plain = F.replace(s, F.lit(" "), F.lit(""))
    country, rest = F.substring(plain, 1, 2), F.substr(plain, F.lit(5), F.length(plain))
    check = lambda body: F.lpad((98 - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
    place = lambda i: F.length(F.replace(F.substr(s, F.lit(1), i), F.lit(" "), F.lit(""))) + 1
    # split(s, '') may end in an empty piece, which must not take a character
    spaced = lambda whole: F.substr(F.array_join(F.transform(_chars(s), lambda c, i: F.when(c == " ", c).otherwise(F.substr(whole, place(i), F.lit(1)))), ""), F.lit(1), F.length(s))
    fresh = _let(_let(permute_text(rest, key, "iban"), lambda body: F.concat(country, check(body), body)), spaced)
    return F.when((_mod97(F.concat(rest, F.substring(plain, 1, 4))) == 1) & F.length(plain).between(15, 34), fresh)


def _ipv4(s: Column, key: Column) -> Column:
    byte = lambda half, high: (F.floor(half / 256) if high else F.pmod(half, F.lit(256))).cast("string")
    shown = lambda p: F.concat_ws(".", byte(p["l"], True), byte(p["l"], False), byte(p["r"], True), byte(p["r"], False))
    fresh = lambda o: F.when(F.array_max(o) <= 255, _let(permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), key, "ipv4"), shown))
    return _let(F.split(s, r"\.").cast("array<int>"), fresh)


def _ssn(s: Column, key: Column) -> Column:
    text = lambda n, width: F.lpad(n.cast("string"), width, "0")
    shown = lambda p: F.concat_ws("-", text(p["l"] + 1 + (p["l"] >= 665).cast("int"), 3), text(F.floor(p["r"] / 9999) + 1, 2), text(F.pmod(p["r"], F.lit(9999)) + 1, 4))
    valid = lambda o: o[0].between(1, 899) & (o[0] != 666) & (o[1] > 0) & (o[2] > 0)
    fresh = lambda o: F.when(valid(o), _let(permute_pair(o[0] - 1 - (o[0] > 666).cast("int"), (o[1] - 1) * 9999 + o[2] - 1, SSN_PARTS, key, "ssn"), shown))
    return _let(F.split(s, "-").cast("array<int>"), fresh)


def _date(s: Column, key: Column) -> Column:
    """Year first, or day.month.year, day-month-year, month/day/year, or day/month/year where only that is valid."""
    zero = F.lit("1900-01-01").cast("date")

    def fresh(order: str) -> Column:
        shown = lambda p: F.date_format(F.date_add(zero, (p["l"] * DAY_PARTS[1] + p["r"]).cast("int")), order)
        pair = lambda day: permute_pair(F.floor(day / DAY_PARTS[1]), F.pmod(day, F.lit(DAY_PARTS[1])), DAY_PARTS, key, "date")
        return _let(F.datediff(F.try_to_date(s, order), zero), lambda day: F.when(day.between(0, DAY_PARTS[0] * DAY_PARTS[1] - 1), _let(pair(day), shown)))

    orders = ((r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{4}/", "yyyy/MM/dd"), (r"^\d{2}\.", "dd.MM.yyyy"), (r"^\d{2}-", "dd-MM-yyyy"), (r"^\d{2}/", "MM/dd/yyyy"), (r"^\d{2}/", "dd/MM/yyyy"))
    return F.coalesce(*[F.when(s.rlike(shape), fresh(order)) for shape, order in orders])


def _phone(s: Column, key: Column) -> Column:
    """The country code stays: one digit for 1 and 7, two for others after a plus sign; none without it."""
    kept = F.when(~s.startswith("+"), 0).when(s.rlike(r"^\+[17]"), 1).otherwise(2)
    fresh = lambda d: F.when(F.length(d).between(8, 15), _refill(s, F.concat(F.substr(d, F.lit(1), kept), permute_text(F.substr(d, kept + 1, F.length(d)), key, "phone"))))
    return _let(_digits(s), fresh)


def _email(s: Column, key: Column) -> Column:
    return F.concat(permute_text(F.substring_index(s, "@", 1), key, "email"), F.lit("@"), F.substring_index(s, "@", -1))


def pseudonym(found: Column, key: Column) -> Column:
    """struct(kind, value) for one match of ANY; kind is null and the value unchanged if it is not valid as its kind."""
    own = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "ipv4": _ipv4, "phone": _phone, "secret": lambda s, k: permute_text(s, k, "secret", True)}
    kind = F.when(found.contains("@"), "email")
    for name in list(own)[1:]:
        kind = kind.when(found.rlike(f"^(?:{PATTERNS[name]})$"), name)

    def fresh(k: Column) -> Column:
        value = F.when(k == "email", own["email"](found, key))
        for name in list(own)[1:]:
            value = value.when(k == name, own[name](found, key))
        return _let(value, lambda v: F.struct(F.when(v.isNotNull(), k).alias("kind"), F.coalesce(v, found).alias("value")))

    return _let(kind, fresh)


def _piece(kind: Column, value: Column) -> Column:
    return F.struct(kind.cast("string").alias("kind"), value.alias("value"))


def _parts(found: Column, group: str, longest: int, fresh: Callable[[Column], Column], kind: str, admissible: Callable[[Column], Column]) -> Column:
    """Pieces of a match: from each boundary of its groups, in order, the longest admissible row of groups that fresh() takes.

    fresh gives null for what is not valid; groups that are in no valid row stay as they are.
    """

    def use(groups: Column) -> Column:
        n = F.size(groups)

        def span(i: Column) -> Column:
            row = lambda k: F.array_join(F.slice(groups, i, k), "")
            lead = F.regexp_extract(groups[i - 1], "^[ -]?", 0)
            bare = lambda k: F.substr(row(k), F.length(lead) + 1, F.length(row(k)))
            tried = F.transform(F.sequence(F.least(n - i + 1, F.lit(longest)), F.lit(1), F.lit(-1)), lambda k: F.struct(k.alias("k"), F.when(admissible(F.slice(groups, i, k)), fresh(bare(k))).alias("v")))
            return _let(F.filter(tried, lambda t: t["v"].isNotNull()), lambda good: F.struct(lead.alias("lead"), F.coalesce(F.get(good, F.lit(0))["k"], F.lit(1)).alias("k"), F.get(good, F.lit(0))["v"].alias("v")))

        empty = F.array().cast("array<struct<kind:string,value:string>>")
        start = F.struct(F.lit(1).alias("next"), empty.alias("out"))

        def step(acc: Column, i: Column) -> Column:
            took = lambda s: F.when(s["v"].isNull(), F.array(_piece(F.lit(None), groups[i - 1]))).otherwise(F.array(_piece(F.lit(None), s["lead"]), _piece(F.lit(kind), s["v"])))
            return F.when(i < acc["next"], acc).otherwise(_let(span(i), lambda s: F.struct((i + s["k"]).alias("next"), F.concat(acc["out"], took(s)).alias("out"))))

        return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda acc: acc["out"])

    return _let(F.regexp_extract_all(found, F.lit(group), F.lit(0)), use)


def _cards(text: Column, key: Column) -> Column:
    """Pieces of a text in which no other kind is.

    A run of 13 to 19 digits may be a card whatever its groups; inside a run each group but the last
    must have three digits or more, so that lists of small numbers are not taken for cards.
    """
    digits = lambda groups: F.length(_digits(F.array_join(groups, ""))).between(13, 19)
    grouped = lambda groups: digits(groups) & ~F.exists(F.slice(groups, 1, F.size(groups) - 1), lambda g: F.length(_digits(g)) < 3)

    def of_run(run: Column) -> Column:
        whole = F.when(F.length(_digits(run)).between(13, 19), _card(run, key))
        return _let(whole, lambda v: F.when(v.isNotNull(), F.array(_piece(F.lit("card"), v))).otherwise(_parts(run, r"[ -]?\d+", 7, lambda s: _card(s, key), "card", grouped)))

    parts, found = F.split(text, DIGITS, -1), F.regexp_extract_all(text, F.lit(DIGITS), F.lit(0))
    pieces = F.flatten(F.zip_with(parts, found, lambda p, m: F.when(m.isNull(), F.array(_piece(F.lit(None), p))).otherwise(F.concat(F.array(_piece(F.lit(None), p)), of_run(m)))))
    return F.when(text.rlike(DIGITS), pieces).otherwise(F.array(_piece(F.lit(None), text)))


def _others(found: Column, key: Column) -> Column:
    """Pieces of a match of ANY; of an IBAN with more groups than its own those that are valid."""
    whole = lambda r: F.array(_piece(r["kind"], r["value"]))
    starts = lambda groups: groups[0].rlike(r"^ ?[A-Z]{2}\d{2}")
    iban = lambda: _parts(found, r" ?[A-Z0-9]+", 9, lambda s: _iban(s, key), "iban", starts)
    return _let(pseudonym(found, key), lambda r: F.when(r["kind"].isNull() & found.rlike(f"^(?:{PATTERNS['iban']})$"), iban()).otherwise(whole(r)))


def _with_cards(pieces: Column, marks: Column, key: Column) -> Column:
    """The pieces with those between the marked places (from 1) put together and searched for cards."""

    def stretch(end: Column, j: Column) -> Column:
        before = F.when(j == 0, 0).otherwise(F.get(marks, j - 1))
        text = F.array_join(F.transform(F.slice(pieces, before + 1, end - before - 1), lambda x: x["value"]), "")
        return F.concat(_let(text, lambda t: _cards(t, key)), F.slice(pieces, end, F.lit(1)))

    return F.flatten(F.transform(F.concat(marks, F.array(F.size(pieces) + 1)), stretch))


def pseudonymised(text: Column, key: str) -> Column:
    """struct(text, kinds): the text with every valid private value replaced, and the kinds in order of place."""
    secret = F.lit(key)
    parts, found = F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    first = F.flatten(F.zip_with(parts, found, lambda p, m: F.when(m.isNull(), F.array(_piece(F.lit(None), p))).otherwise(F.concat(F.array(_piece(F.lit(None), p)), _others(m, secret)))))
    pieces = lambda known: _let(F.filter(F.sequence(F.lit(1), F.size(known)), lambda i: known[i - 1]["kind"].isNotNull()), lambda marks: _with_cards(known, marks, secret))
    kinds = lambda all_: F.filter(F.transform(all_, lambda x: x["kind"]), lambda k: k.isNotNull())
    done = _let(_let(first, pieces), lambda all_: F.struct(F.array_join(F.transform(all_, lambda x: x["value"]), "").alias("text"), kinds(all_).alias("kinds")))
    touched = text.rlike("[0-9@]|[A-Fa-f]{32}") & (text.rlike(ANY) | text.rlike(DIGITS))
    return F.when(touched, done).otherwise(F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds")))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text, n_private, kinds (comma-separated, sorted, distinct); one row per input row, in one pass.

    Validated are: cards by the Luhn digit, IBANs by mod 97, dates by the calendar (1900-01-01 to
    2099-08-04), social security numbers and IPv4 addresses by their ranges, phone numbers by 8 to 15
    digits. What is not valid stays. Of digit runs and IBANs that are not valid as a whole the valid rows
    of groups are replaced, from the left, the longest first. Equal values get equal pseudonyms in every document under one key,
    whatever their separators. Null text stays null; repeated rows are treated alike; other columns
    are ignored.
    """
    done = docs.select(F.col("doc_id"), pseudonymised(F.col("text"), key).alias("p"))
    return done.select("doc_id", F.col("p.text").alias("text"), F.size("p.kinds").alias("n_private"), F.array_join(F.array_sort(F.array_distinct("p.kinds")), ",").alias("kinds"))
