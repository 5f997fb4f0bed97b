"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Candidates are found by one regular expression, validated (Luhn, octets, calendar, number plan), and moved by a keyed
Feistel network inside their own format's domain, so a pseudonym is valid too, equal values get equal pseudonyms in
every document, and different values different ones:

    payment card   first digit stays, middle digits permuted, Luhn digit computed anew
    phone          area 200-999, exchange 200-999, line 0000-9999; all other areas and exchanges among themselves
    IPv4           all 2^32 addresses
    SSN            valid areas, groups and serials
    date           days of a block of 400 years, written in the same order and separators; day and month first apart
    e-mail         local part: letters and digits inside their class, domain kept

Numbers joined by single separators may hold several values or others beside them; from 13 digits on, such a run is
read group by group, and from each group on the longest valid card counts, else any other candidate.

A domain Z_A x Z_B is permuted by alternating rounds l += F(r) mod A, r += F(l) mod B; F is a keyed SHA-256.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,8}"
PHONE = r"(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
YMD = r"[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}(?![0-9])"
DMY = r"[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4}(?![0-9]|\.[0-9])"
IPV4 = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
CARD = r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
#: A group of digits that doesn't begin an e-mail address; possessive, so long runs need no stack.
GROUP = r"[0-9]++(?![A-Za-z0-9._%+-]{0,64}@)"
RUN = rf"(?=[0-9](?:[ -]?[0-9]){{12}}){GROUP}(?:[ ./-]{GROUP})*+"
OTHER = rf"(?:{PHONE}|{SSN}|{YMD}|{DMY}|{IPV4})"
#: The most groups that a card (all of one digit) and any other candidate with what it must not be followed by can have.
CARD_GROUPS, OTHER_GROUPS = 19, 6
ANY = rf"(?<![0-9A-Za-z_])(?=[0-9(+]|[A-Za-z0-9._%+-]++@)(?:{EMAIL}|{PHONE}|{SSN}|{YMD}|{DMY}|{IPV4}|{RUN})"


def long(c: Column) -> Column:
    return c.cast("long")


def whole(a: Column, b: int | Column) -> Column:
    """Integer division, exact for all longs (a double holds 53 bits only)."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("long"))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def prf(key: str, kind: str, round_no: Column, *inputs: Column) -> Column:
    """60 keyed pseudo-random bits."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), round_no.cast("string"), *[x.cast("string") for x in inputs])
    return long(F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10))


def feistel(value: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. a*b-1."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        let(value, lambda v: F.struct(whole(v, b).alias("l"), long(v % b).alias("r"))),
        lambda acc, i: F.when(i % 2 == 1, F.struct(long((acc["l"] + prf(key, kind, i, acc["r"]) % a) % a).alias("l"), acc["r"].alias("r"))).otherwise(F.struct(acc["l"].alias("l"), long((acc["r"] + prf(key, kind, i, acc["l"]) % b) % b).alias("r"))),
        lambda acc: acc["l"] * b + acc["r"],
    )


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def padded(n: Column, width: int | Column) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def refilled(shape: Column, digits: Column) -> Column:
    """The shape's digits replaced, one after the other, by those of the same number of digits."""

    def fill(new: Column) -> Column:
        place = lambda i: F.length(digits_of(F.substring(shape, F.lit(1), i)))
        one = lambda i: let(F.substring(shape, i, F.lit(1)), lambda c: F.when(c.between("0", "9"), F.substring(new, place(i), F.lit(1))).otherwise(c))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), one), "")

    return let(digits, fill)


def luhn_sum(digits: Column, odd: int) -> Column:
    """Sum from the right; digits at places of that parity (1: the last, the third last ...) count twice."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = long(F.substring(digits, n - i + 1, F.lit(1)))
        return acc + F.when(i % 2 == odd, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0).cast("long"), add)


def power10(n: Column) -> Column:
    return long(F.concat(F.lit("1"), F.repeat(F.lit("0"), n)))


def card(m: Column, key: str) -> Column:
    def move(d: Column) -> Column:
        n = F.length(d) - 2
        half = F.floor(n / 2).cast("int")
        moved = feistel(long(F.substring(d, F.lit(2), n)), power10(n - half), power10(half), key, "card")
        payload = F.concat(F.substring(d, 1, 1), padded(moved, n))
        full = let(payload, lambda p: F.concat(p, ((10 - luhn_sum(p, 1) % 10) % 10).cast("string")))
        return F.when(luhn_sum(d, 0) % 10 == 0, refilled(m, full))

    return let(digits_of(m), move)


def phone(m: Column, key: str) -> Column:
    def move(d: Column) -> Column:
        area, exchange, line = (long(F.substring(d, F.length(d) - a, F.lit(n))) for a, n in ((9, 3), (6, 3), (3, 4)))
        moved = feistel(((area - 200) * 800 + (exchange - 200)) * 10000 + line, F.lit(640000).cast("long"), F.lit(10000).cast("long"), key, "phone")
        out = let(moved, lambda x: F.concat((whole(x, 8_000_000) + 200).cast("string"), (whole(x, 10000) % 800 + 200).cast("string"), padded(x % 10000, 4)))
        # outside the number plan: areas below 200 with any exchange, then the other areas with exchanges below 200
        place = F.when(area < 200, area * 1000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange)
        moved = feistel(place * 10000 + line, F.lit(360000).cast("long"), F.lit(10000).cast("long"), key, "phone outside")

        def written(x: Column) -> Column:
            at = whole(x, 10000)
            code = F.when(at < 200_000, at).otherwise((whole(at - 200_000, 200) + 200) * 1000 + (at - 200_000) % 200)
            return F.concat(padded(code, 6), padded(x % 10000, 4))

        out = F.when((area >= 200) & (exchange >= 200), out).otherwise(let(moved, written))
        return refilled(m, F.concat(F.when(F.length(d) == 11, F.lit("1")).otherwise(""), out))

    return let(digits_of(m), move)


def ipv4(m: Column, key: str) -> Column:
    def move(parts: Column) -> Column:
        side = F.lit(65536).cast("long")
        value = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x)
        octets = lambda x: F.concat_ws(".", *[F.shiftright(x, k).bitwiseAND(F.lit(255).cast("long")).cast("string") for k in (24, 16, 8, 0)])
        return F.when(F.forall(parts, lambda x: x <= 255), let(feistel(value, side, side, key, "ipv4"), octets))

    return let(F.transform(F.split(m, r"\."), long), move)


def ssn(m: Column, key: str) -> Column:
    area, group, serial = (long(F.substring(m, a, n)) for a, n in ((1, 3), (5, 2), (8, 4)))
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    moved = feistel((index * 99 + group - 1) * 9999 + serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, "ssn")

    def written(x: Column) -> Column:
        place = whole(x, 99 * 9999) + 1
        return F.concat_ws("-", padded(F.when(place > 665, place + 1).otherwise(place), 3), padded(whole(x, 9999) % 99 + 1, 2), padded(x % 9999 + 1, 4))

    return F.when((area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1), let(moved, written))


#: Years go in blocks of 400, which all have 146,097 days: 200-599, ..., 9400-9799. What is left at both ends of the four
#: digits, 9800-9999 and then 1-199, makes one more block of 399 years.
BLOCK_YEARS, FIRST_YEAR, LAST_YEAR = 400, 200, 9800
BLOCK_DAYS, EDGE_DAYS = 5411 * 27, 1567 * 93
#: Days of the edge block before year 1.
EDGE_HEAD = 73048
#: Days 13 and later of the months before each month, in a year without 29 February.
LATE_DAYS = (0, 19, 35, 54, 72, 91, 109, 128, 147, 165, 184, 202, 221)


def in_block(year: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f(place of a year in its block, years of the block)."""
    edge = (year < FIRST_YEAR) | (year >= LAST_YEAR)
    place = F.when(year >= LAST_YEAR, year - LAST_YEAR).when(year < FIRST_YEAR, year + 199).otherwise((year - FIRST_YEAR) % BLOCK_YEARS)
    return f(long(place), F.when(edge, 399).otherwise(BLOCK_YEARS).cast("long"))


def year_at(year: Column, place: Column) -> Column:
    """The year at that place of the block that year lies in."""
    edge = F.when(place < 200, LAST_YEAR + place).otherwise(place - 199)
    return F.when((year < FIRST_YEAR) | (year >= LAST_YEAR), edge).otherwise(year - (year - FIRST_YEAR) % BLOCK_YEARS + place)


def is_leap(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def is_date(year: Column, month: Column, day: Column) -> Column:
    most = F.when(month == 2, 28 + is_leap(year).cast("int")).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return (year >= 1) & month.between(1, 12) & (day >= 1) & (day <= most)


def moved_day(year: Column, month: Column, day: Column, key: str) -> Column:
    """A date of the same block of years, by a permutation of its days."""
    date, edge = F.make_date(year, month, day), (year < FIRST_YEAR) | (year >= LAST_YEAR)
    first = lambda y: F.make_date(y, F.lit(1), F.lit(1))
    start = first((year - (year - FIRST_YEAR) % BLOCK_YEARS).cast("int"))
    inside = long(F.datediff(date, start))
    ends = long(F.when(year >= LAST_YEAR, F.datediff(date, first(F.lit(LAST_YEAR)))).otherwise(F.datediff(date, first(F.lit(1))) + EDGE_HEAD))
    moved = lambda x, a, b, kind: feistel(x, F.lit(a).cast("long"), F.lit(b).cast("long"), key, kind)
    back = lambda x: F.when(x < EDGE_HEAD, F.date_add(first(F.lit(LAST_YEAR)), x.cast("int"))).otherwise(F.date_add(first(F.lit(1)), (x - EDGE_HEAD).cast("int")))
    return F.when(edge, let(moved(ends, 1567, 93, "date edge"), back)).otherwise(F.date_add(start, moved(inside, 5411, 27, "date").cast("int")))


def date_parts(m: Column, starts: tuple[int, int, int]) -> list[Column]:
    """Year and two other numbers at these places."""
    return [F.substring(m, at, n).cast("int") for at, n in zip(starts, (4, 2, 2), strict=True)]


def ymd(m: Column, key: str) -> Column:
    year, month, day = date_parts(m, (1, 6, 9))
    written = lambda x: F.replace(F.date_format(x, "yyyy-MM-dd"), F.lit("-"), F.substring(m, 5, 1))
    return F.when(is_date(year, month, day), let(moved_day(year, month, day, key), written))


def dmy(m: Column, key: str) -> Column:
    """A day and a month in either order, and a year.

    Strings that can be read both ways (two numbers up to 12) are permuted among themselves, so are those with the day
    first, and those with the month first: a pseudonym can be read just as its original, and no two of them meet. In the
    latter two the days from 13 on go by their place in a year of 221 such days; 29 February is moved among leap years."""
    year, one, two = date_parts(m, (7, 1, 4))
    mark = F.substring(m, 3, 1)
    text = lambda a, b, y: F.concat_ws("", padded(a, 2), mark, padded(b, 2), mark, padded(y, 4))

    def both() -> Column:
        value = in_block(year, lambda place, years: feistel(place * 144 + (one - 1) * 12 + two - 1, years, F.lit(144).cast("long"), key, "date either way"))
        return let(value, lambda x: text(whole(x, 12) % 12 + 1, x % 12 + 1, year_at(year, whole(x, 144))))

    before = F.array(*[F.lit(n) for n in LATE_DAYS])

    def ordered(day: Column, month: Column, first: bool) -> Column:
        write = lambda d, mo, y: text(d, mo, y) if first else text(mo, d, y)
        place = long(F.element_at(before, month) + day - 13)
        value = in_block(year, lambda at, years: feistel(at * 221 + place, years, F.lit(221).cast("long"), key, "date late"))

        def late(x: Column) -> Column:
            at = x % 221
            return let(F.size(F.filter(before, lambda n: n <= at)), lambda mo: write(at - F.element_at(before, mo) + 13, mo, year_at(year, whole(x, 221))))

        # the leap years of a block, by place: every fourth one but for three (the edge block: four) of its centuries
        leaps = lambda years: F.filter(F.sequence(F.lit(0).cast("long"), years - 1), lambda at: is_leap(year_at(year, at)))
        by = F.pmod(prf(key, "date leap day", F.lit(0)), F.lit(97).cast("long"))
        leap = in_block(year, lambda at, years: let(leaps(years), lambda all_: F.element_at(all_, (F.pmod(F.array_position(all_, at) - 1 + by, F.size(all_)) + 1).cast("int"))))
        return F.when((month == 2) & (day == 29), write(F.lit(29), F.lit(2), year_at(year, leap))).otherwise(let(value, late))

    either = one.between(1, 12) & two.between(1, 12) & (year >= 1)
    return F.when(either, both()).when((one > 12) & is_date(year, two, one), ordered(one, two, True)).when((two > 12) & is_date(year, one, two), ordered(two, one, False))


CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")


def shifted(s: Column, seed: Column) -> Column:
    """Each letter and digit of s moved inside its class by keyed amounts."""

    def one(i: Column) -> Column:
        c = F.substring(s, i, F.lit(1))
        by = long(F.conv(F.substring(F.sha2(F.concat_ws("|", seed, i.cast("string")).cast("binary"), 256), 1, 8), 16, 10))
        out = c
        for letters in CLASSES:
            at = F.instr(F.lit(letters), c)
            out = F.when(at > 0, F.substring(F.lit(letters), (((at - 1) + by) % len(letters) + 1).cast("int"), F.lit(1))).otherwise(out)
        return out

    return F.when(F.length(s) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), one), "")).otherwise("")


def email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    half = ((F.length(local) + 1) / 2).cast("int")
    start = F.struct(F.substring(local, F.lit(1), half).alias("l"), F.substring(local, half + 1, F.length(local)).alias("r"))
    seed = lambda i, other: F.concat_ws("|", F.lit(key), F.lit("email"), i.cast("string"), other)
    turned = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        start,
        lambda acc, i: F.when(i % 2 == 1, F.struct(shifted(acc["l"], seed(i, acc["r"])).alias("l"), acc["r"].alias("r"))).otherwise(F.struct(acc["l"].alias("l"), shifted(acc["r"], seed(i, acc["l"])).alias("r"))),
        lambda acc: F.concat(acc["l"], acc["r"]),
    )
    return F.concat(turned, F.substring(m, F.instr(m, "@"), F.length(m)))


KINDS: list[tuple[str, Callable[[Column, str], Column]]] = [
    (EMAIL, email),
    (PHONE, phone),
    (SSN, ssn),
    (YMD, ymd),
    (DMY.replace(r"\2", r"\1"), dmy),
    (IPV4, ipv4),
    (CARD, card),
]


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of a candidate; null if it isn't valid."""
    out = None
    for rx, f in KINDS:
        found, made = m.rlike(rf"\A(?:{rx})\z"), f(m, key)
        out = F.when(found, made) if out is None else out.when(found, made)
    return out


def pieces(m: Column) -> Column:
    """The parts of a candidate, in order: of a run its cards, its other candidates and what lies between; else itself."""

    def parts(groups: Column) -> Column:
        text = lambda i, n: F.array_join(F.slice(groups, i, n), "")
        no_mark = lambda t: F.regexp_replace(t, "[ ./-]$", "")

        def is_card(t: Column) -> Column:
            return F.when(t.rlike(rf"\A(?:{CARD})\z"), luhn_sum(digits_of(t), 0) % 10 == 0).otherwise(False)

        def taken(i: Column) -> Column:
            """How many groups from the i-th on belong to one value; 0: it begins none."""
            cards = F.filter(F.sequence(F.least(F.lit(CARD_GROUPS), F.size(groups) - i + 1), F.lit(1)), lambda n: let(no_mark(text(i, n)), is_card))
            other = F.size(F.regexp_extract_all(F.regexp_extract(text(i, F.lit(OTHER_GROUPS)), rf"\A{OTHER}", 0), F.lit("[0-9]+"), F.lit(0)))
            return F.when(F.size(cards) > 0, F.element_at(cards, 1)).otherwise(other)

        def step(acc: Column, i: Column) -> Column:
            def take(n: Column) -> Column:
                value = text(i, n)
                found = F.array(text(acc["upto"] + 1, i - acc["upto"] - 1), no_mark(value), F.regexp_extract(value, "[ ./-]?$", 0))
                return F.when(n > 0, F.struct((i + n - 1).alias("upto"), F.concat(acc["out"], found).alias("out"))).otherwise(acc)

            return F.when(i > acc["upto"], let(taken(i), take)).otherwise(acc)

        start = F.struct(F.lit(0).alias("upto"), F.array().cast("array<string>").alias("out"))
        rest = lambda acc: F.concat(acc["out"], F.array(text(acc["upto"] + 1, F.size(groups))))
        return F.aggregate(F.sequence(F.lit(1), F.size(groups)), start, step, rest)

    return F.when(m.rlike(rf"\A(?:{RUN})\z"), let(F.regexp_extract_all(m, F.lit("[0-9]+[ ./-]?"), F.lit(0)), parts)).otherwise(F.array(m))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with the personal data in text_col replaced by pseudonyms, and ``n_pii``, the number of replacements.

    A null text stays null with n_pii 0; an empty text, and one without valid candidates, stays as it is. Every row is
    treated on its own, so repeated rows get equal results; other columns pass through (a column named n_pii is
    replaced). An empty table gives an empty table."""
    text = F.col(text_col)
    pairs = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: F.transform(pieces(m), lambda p: F.struct(p.alias("old"), pseudonym(p, key).alias("new"))))
    out = docs.withColumn("_pairs", F.when(text.rlike(ANY), pairs))
    gaps = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(gaps, F.col("_pairs"), lambda g, ps: F.concat(g, F.coalesce(F.array_join(F.transform(ps, lambda p: F.coalesce(p["new"], p["old"])), ""), F.lit("")))), "")
    out = out.withColumn("n_pii", F.coalesce(F.size(F.filter(F.flatten("_pairs"), lambda p: p["new"].isNotNull())), F.lit(0)).cast("long"))
    out = out.withColumn("n_pii", F.greatest("n_pii", F.lit(0).cast("long")))
    return out.withColumn(text_col, F.when(F.col("n_pii") > 0, joined).otherwise(text)).drop("_pairs")
