"""Format-preserving pseudonyms for validated numbers and dates, by keyed Feistel permutations.

Found: payment cards (Luhn), IBANs (mod 97), US social security numbers,
phone numbers, IPv4 addresses, calendar dates and e-mail local parts.  A
match that fails its check stays as it is.  Cards and IBANs are looked for at
every start and with every end at a separator, the longest valid first, so
that an expiry date, a code or a currency beside them does not hide them; of
two that overlap the one with more digits is taken.  Every kind is permuted inside
its own format, so the result is again a valid value of that kind, and equal
values get equal pseudonyms in all documents whatever their separators.
All of it is built-in SQL functions on the row's own text: no shuffle, no Python.

Permutations are bijections; a value can be its own image (for dates with
probability 1 in 73,049).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_row, field

ROUNDS = 8  # even, so that halves end where they began
WALKS = 64

_BEFORE, _AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: Patterns by kind, in order of precedence.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,24}",
    "iban": _BEFORE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _AFTER,
    "date": r"(?<![\p{L}\p{N}./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})"
            r"(?![\p{L}\p{N}]|[./-][0-9])",
    "ip": r"(?<![\p{L}\p{N}]|[0-9]\.)(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\p{L}\p{N}]|\.[0-9])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}]|-[0-9])",
    # With +1 ten digits follow; elsewhere at most 15 digits in all.  No card begins inside (CARDS: those of the text).
    "phone": r"(?<![\p{L}\p{N}+])(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
             r"|\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?(?!CARDS)[0-9]{2,4}){1,4}"
             r"(?<!\+" + r"[ .()-]{0,3}[0-9]" * 16 + r"[0-9 .()-]{0,30})"
             r"|(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4})(?![\p{L}\p{N}]|-[0-9])",
    "card": _BEFORE + r"[0-9](?:[ -]?[0-9]){12,18}" + _AFTER,
}
#: What may be a card or an IBAN, at every place where one may begin.
_STARTS = {"card": r"(?=([0-9](?:[ -]?[0-9]){12,18})(?![\p{L}\p{N}]))" + _BEFORE,
           "iban": r"(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![\p{L}\p{N}]))" + _BEFORE}
_NEVER = "(?!)"
_FIRST_DAY, _DAYS = "1900-01-01", 73_049  # to 2099-12-31


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hash(key: str, tweak: str, turn: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), turn.cast("string"), half.cast("string")), 512)


def _number(hexes: Column, at: Column, digits: int) -> Column:
    return F.conv(F.substr(hexes, at, F.lit(digits)), 16, 10).cast("long")


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _rounds(first: Column, second: Column, turn: Callable[[Column, Column, Column], Column],
            finish: Callable[[Column, Column], Column]) -> Column:
    """Feistel network: each turn moves the first half by a keyed function of the second and swaps them."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(first.alias("a"), second.alias("b")),
                       lambda s, i: F.struct(s["b"].alias("a"), turn(s["a"], s["b"], i).alias("b")),
                       lambda s: finish(s["a"], s["b"]))


def permute_text(text: Column, key: str, tweak: str) -> Column:
    """Keyed permutation of a string: digits stay digits, a-z and A-Z stay so, other characters stay."""
    def moved(char: Column, by: Column) -> Column:
        code = F.ascii(char)
        return (F.when(code.between(48, 57), F.char(48 + (code - 48 + by) % 10))
                .when(code.between(97, 122), F.char(97 + (code - 97 + by) % 26))
                .when(code.between(65, 90), F.char(65 + (code - 65 + by) % 26)).otherwise(char))

    def turn(a: Column, b: Column, i: Column) -> Column:
        return let(_hash(key, tweak, i, b), lambda h: F.array_join(
            F.transform(_chars(a), lambda c, k: moved(c, _number(h, (k % 32) * 4 + 1, 4))), ""))

    return let(text, lambda t: let(F.floor(F.length(t) / 2).cast("int"), lambda u: _rounds(
        F.substr(t, F.lit(1), u), F.substr(t, u + 1, F.length(t)), turn, F.concat)))


def permute_number(number: Column, size: int, key: str, tweak: str,
                   valid: Callable[[Column], Column] | None = None) -> Column:
    """Keyed permutation of 0..size-1 (only of its ``valid`` numbers, if given), by cycle walking."""
    side = math.isqrt(size - 1) + 1

    def once(x: Column) -> Column:
        return _rounds(F.floor(x / side).cast("long"), x % side,
                       lambda a, b, i: (a + _number(_hash(key, tweak, i, b), F.lit(1), 12)) % side,
                       lambda a, b: a * side + b)

    def inside(x: Column) -> Column:
        return x < size if valid is None else F.when(x < size, valid(x)).otherwise(F.lit(False))

    if valid is None and side * side == size:
        return once(number)
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), F.struct(number.alias("x"), F.lit(False).alias("done")),
                       lambda s, _: F.when(s["done"], s).otherwise(
                           let(once(s["x"]), lambda y: F.struct(y.alias("x"), inside(y).alias("done")))),
                       lambda s: s["x"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(template: Column, chars: Column, kind: str = "[0-9]") -> Column:
    """``template`` with its characters of ``kind`` replaced, in order, by those of ``chars``."""
    return F.array_join(F.zip_with(F.split(template, kind, -1), _chars(chars),
                                   lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")


def _luhn(digits: Column, doubled: int) -> Column:
    """Luhn sum; ``doubled`` is the parity, from the right, of the doubled digits."""
    each = F.transform(_chars(F.reverse(digits)), lambda c, i: let(
        c.cast("int") * F.when(i % 2 == doubled, 2).otherwise(1), lambda v: v - F.when(v > 9, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, v: a + v)


def _mod97(text: Column) -> Column:
    return F.aggregate(_chars(text), F.lit(0), lambda a, c: F.when(
        c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _iban_valid(s: Column) -> Column:
    return _mod97(F.concat(F.substr(s, F.lit(5), F.length(s)), F.substr(s, F.lit(1), F.lit(4)))) == 1


def _longest_valid(m: Column, kind: str) -> Column:
    """The longest valid card or IBAN that begins where ``m`` does and ends with it or before a separator; or null."""
    def ends(k: Column) -> Column:
        return (F.substr(m, k + 1, F.lit(1)).isin("", " ", "-")) & ~F.substr(m, k, F.lit(1)).isin(" ", "-")

    def valid(c: Column) -> Column:
        if kind == "card":
            return let(_digits(c), lambda d: (F.length(d) >= 13) & (_luhn(d, 1) % 10 == 0))
        return c.rlike("^(?:" + PATTERNS["iban"] + ")$") & _iban_valid(F.regexp_replace(c, " ", ""))

    places = F.filter(F.sequence(F.length(m), F.lit(12), F.lit(-1)), ends)
    return F.get(F.filter(F.transform(places, lambda k: F.substr(m, F.lit(1), k)), valid), F.lit(0))


def _overlapped(c: Column, later: Column) -> Column:
    """Whether one of ``later``, with more digits, begins inside the card ``c``."""
    tails = F.transform(F.filter(F.sequence(F.lit(2), F.length(c)), lambda k: F.substr(c, k - 1, F.lit(1)).isin(" ", "-")),
                        lambda k: F.substr(c, k, F.length(c)))
    return F.exists(later, lambda x: F.coalesce((F.length(_digits(x)) > F.length(_digits(c)))
                                                & F.exists(tails, lambda t: F.startswith(x, t)), F.lit(False)))


def _alternatives(text: Column, kind: str) -> Column:
    """Pattern of the valid cards or IBANs in a text, the longest first."""
    starts = F.regexp_extract_all(text, F.lit(_STARTS[kind]), F.lit(1))
    found = F.transform(starts, lambda m: _longest_valid(m, kind))
    if kind == "card":
        found = let(found, lambda every: F.filter(every, lambda c, i: c.isNotNull() & ~_overlapped(c, F.slice(every, i + 2, F.lit(18)))))
    ordered = F.reverse(F.array_sort(F.transform(F.array_distinct(F.filter(found, lambda c: c.isNotNull())),
                                                 lambda c: F.struct(F.length(c).alias("n"), c.alias("c")))))
    return let(F.array_join(F.transform(ordered, lambda x: x["c"]), "|"), lambda p: F.when(p == "", _NEVER).otherwise(
        F.concat(F.lit(_BEFORE + "(?:"), p, F.lit(")" + _AFTER))))


def _card(m: Column, key: str) -> Column:
    return let(_digits(m), lambda d: F.when(_luhn(d, 1) % 10 == 0, let(
        permute_text(F.substr(d, F.lit(1), F.length(d) - 1), key, "card"),
        lambda p: _refill(m, F.concat(p, ((10 - _luhn(p, 0) % 10) % 10).cast("string"))))).otherwise(m))


def _iban(m: Column, key: str) -> Column:
    def renewed(s: Column) -> Column:
        country = F.substr(s, F.lit(1), F.lit(2))
        return let(permute_text(F.substr(s, F.lit(5), F.length(s)), key, "iban"), lambda body: _refill(
            m, F.concat(country, F.lpad((98 - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0"), body),
            "[A-Z0-9]"))

    return let(F.regexp_replace(m, " ", ""), lambda s: F.when(_iban_valid(s), renewed(s)).otherwise(m))


def _ssn(m: Column, key: str) -> Column:
    def part(i: int) -> Column:
        return F.element_at(F.split(m, "-"), i).cast("long")

    area, group, serial = part(1), part(2), part(3)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1

    def spelt(x: Column) -> Column:
        at = F.floor(x / (99 * 9999))
        return F.concat_ws("-", F.lpad((at + F.when(at >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
                           F.lpad((F.floor(x / 9999) % 99 + 1).cast("string"), 2, "0"),
                           F.lpad((x % 9999 + 1).cast("string"), 4, "0"))

    return F.when(valid, let(permute_number(place, 898 * 99 * 9999, key, "ssn"), spelt)).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    """The country code after a plus sign stays."""
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}", 0)
    return let(F.substr(m, F.length(code) + 1, F.length(m)), lambda rest: let(_digits(rest), lambda d: F.when(
        F.length(_digits(m)).between(8, 15), F.concat(code, _refill(rest, permute_text(d, key, "phone")))).otherwise(m)))


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))

    def spelt(x: Column) -> Column:
        return F.concat_ws(".", *[F.shiftrightunsigned(x, b).bitwiseAND(255).cast("string") for b in (24, 16, 8, 0)])

    return let(octets, lambda o: F.when(F.forall(o, lambda x: x <= 255), let(permute_number(
        F.aggregate(o, F.lit(0).cast("long"), lambda a, x: a * 256 + x), 1 << 32, key, "ip"), spelt)).otherwise(m))


def _date(m: Column, key: str) -> Column:
    """Year first; or day first with dots; else month first where that is a date, or day first (its day stays over 12)."""
    first = F.lit(_FIRST_DAY).cast("date")

    def day_number(y: Column, mo: Column, d: Column) -> Column:
        known = y.between(1900, 2099) & mo.between(1, 12) & d.between(1, 31)
        return F.when(known, let(F.make_date(y, mo, F.lit(1)), lambda start: F.when(
            d <= F.day(F.last_day(start)), F.datediff(start, first) + d - 1)))

    def written(n: Column, order: str, p: Column) -> Column:
        date = F.date_add(first, n.cast("int"))
        value = {"y": F.year(date), "m": F.month(date), "d": F.day(date)}
        separator = F.regexp_extract(m, "[-/.]", 0)
        parts = [F.when(F.length(p[i]) >= 2, F.lpad(value[c].cast("string"), 4 if c == "y" else 2, "0"))
                 .otherwise(value[c].cast("string")) for i, c in enumerate(order)]
        return F.concat(parts[0], separator, parts[1], separator, parts[2])

    def as_order(p: Column, order: str, late: bool = False) -> Column:
        y, mo, d = (p[order.index(c)].cast("int") for c in "ymd")

        def over_twelve(n: Column) -> Column:
            return F.day(F.date_add(first, n.cast("int"))) > 12

        return let(day_number(y, mo, d), lambda n: F.when(n.isNotNull(), let(
            permute_number(n.cast("long"), _DAYS, key, "late date" if late else "date", over_twelve if late else None),
            lambda x: written(x, order, p))))

    return let(F.split(m, "[-/.]"), lambda p: F.coalesce(
        F.when(F.length(p[0]) == 4, as_order(p, "ymd")).when(m.contains("."), as_order(p, "dmy")).otherwise(as_order(p, "mdy")),
        F.when((F.length(p[0]) != 4) & ~m.contains("."), F.when(p[0].cast("int") > 12, as_order(p, "dmy", late=True))), m))


def _email(m: Column, key: str) -> Column:
    return F.concat(permute_text(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


_KINDS = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(match: Column, key: str) -> Column:
    """The pseudonym of one match, or the match itself if its check fails."""
    chosen = None
    for kind, change in _KINDS.items():
        test = match.rlike("^(?:" + PATTERNS[kind].replace("CARDS", _NEVER) + ")$")
        chosen = F.when(test, change(match, key)) if chosen is None else chosen.when(test, change(match, key))
    return chosen.otherwise(match)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """One row per input row: row (struct of all its columns), text (with pseudonyms), found (values replaced).

    Texts without validated values come back unchanged, null stays null with
    found 0, and empty tables give an empty result; the whole text is read.
    """
    # Numbered groups of single patterns count on in the union; the date pattern refers to its own by number.
    # Cards and IBANs stand in it as the valid ones of the text.
    names = {"card": "CARDS", "iban": "IBANS"}
    union = "|".join(f"(?:{names.get(k, p)})" for k, p in PATTERNS.items() if k != "date")
    union = F.lit(f"(?:{PATTERNS['date']})|{union}")
    rows = as_row(docs).withColumn("old", field("row", text_col))
    for kind, name in names.items():
        union = F.replace(union, F.lit(name), F.when(F.col("old").rlike("[0-9]"), _alternatives(F.col("old"), kind)).otherwise(_NEVER))
    rows = rows.withColumn("union", F.when(F.col("old").rlike("[0-9@]"), union))
    parts = F.transform(F.regexp_extract_all("old", F.col("union"), F.lit(0)),
                        lambda m: F.struct(m.alias("m"), pseudonym(m, key).alias("p")))
    rows = rows.withColumn("parts", F.when(F.col("union").isNotNull(), parts))
    text = F.when(F.size("parts") > 0, F.array_join(F.zip_with(
        F.split("old", F.col("union"), -1), "parts", lambda gap, x: F.concat(gap, F.coalesce(x["p"], F.lit("")))), "")).otherwise(F.col("old"))
    found = F.coalesce(F.size(F.filter("parts", lambda x: x["m"] != x["p"])), F.lit(0))
    return rows.select("row", text.alias("text"), F.when(F.col("parts").isNull(), 0).otherwise(found).alias("found"))


def replace_personal(docs: DataFrame, key: str, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with its text pseudonymised and, where the text changed, its length column brought up to date."""
    done = pseudonymise(docs, key, text_col)
    columns = []
    for c in docs.columns:
        value = field("row", c)
        if c == text_col:
            value = F.col("text")
        elif c == length_col:
            value = F.when(F.col("found") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(value)
        columns.append(value.alias(c))
    return done.select(*columns)
