"""Scalar text functions, all as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: The characters that Unicode calls white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def strip(c: Column | str) -> Column:
    """Unicode white space removed at both ends; looks at the ends only."""
    return F.btrim(col(c), F.lit(WHITE))


def squeeze(c: Column | str) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def tokens(c: Column | str) -> Column:
    """Lower-case ASCII letter and digit runs; accented letters split words."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]+"), F.lit(0))


def content_hash(c: Column | str) -> Column:
    return F.sha1(squeeze(c))


def html_to_text(c: Column | str) -> Column:
    """Visible text by regular expressions: scripts and styles go, tags become spaces, white space is squeezed."""
    bare = F.regexp_replace(col(c), r"(?is)<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)>", " ")
    return squeeze(F.regexp_replace(bare, r"(?s)<[^>]+>", " "))


def chunks(c: Column | str, size: int = 1500, overlap: int = 200) -> Column:
    """Fixed-stride windows over the stripped text; the last may lie inside the one before."""
    step = size - overlap

    def cut(text: Column) -> Column:
        starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))
        return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    return let(strip(c), cut)


def basename(c: Column | str) -> Column:
    return F.element_at(F.split(col(c), "/"), -1)


def stem(c: Column | str) -> Column:
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]*$", "")


def slug(c: Column | str, size: int = 60, fallback: str = "file") -> Column:
    """Runs of other characters become one underscore, none at the ends, cut to size; never empty."""
    s = F.regexp_replace(F.regexp_replace(col(c), r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, size), F.lit("")), F.lit(fallback))


def fingerprint(c: Column | str, size: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", ""), 1, size)


def letter_share(c: Column | str) -> Column:
    """Share of letters, digits and white space (ASCII) among all characters; 0 for the empty text."""
    kept = F.length(F.regexp_replace(col(c), r"[^A-Za-z0-9 \t\n\r]", ""))
    return F.when(F.length(col(c)) > 0, kept / F.length(col(c))).otherwise(0.0)


def token_estimate(c: Column | str) -> Column:
    return F.floor(F.length(col(c)) / 4)


def first_match(c: Column | str, rx: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none."""
    return F.nullif(F.regexp_extract(col(c), rx, group), F.lit(""))


def substitutions(c: Column | str, rules: list[tuple[str, str]]) -> Column:
    """Ordered regular-expression replacements, each on the result of the one before; \\1 names a group."""
    out = col(c)
    for rx, by in rules:
        out = F.regexp_replace(out, rx, re.sub(r"\\(\d)", r"$\1", by))
    return out


def base64url(c: Column | str) -> Column:
    return F.unbase64(F.translate(col(c), "-_", "+/"))


def dashed(c: Column | str, size: int = 60) -> Column:
    """Letters, digits and underscores of any script kept, runs of blanks, underscores and dashes become one dash, lower case."""
    kept = strip(F.regexp_replace(col(c), r"(?U)[^\w\s-]", ""))
    cut = F.substring(F.regexp_replace(kept, r"(?U)[\s_-]+", "-"), 1, size)
    return F.coalesce(F.nullif(F.lower(F.btrim(cut, F.lit("-"))), F.lit("")), F.lit("untitled"))


def url_file_name(url: Column | str) -> Column:
    """A file name for a page's address: path and query in safe characters, .html at the end, at most 200 characters."""
    raw = F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    raw = F.when(raw == "", "/").when(raw.startswith("?"), F.concat(F.lit("/"), raw)).otherwise(raw)
    raw = F.when(raw.endswith("/"), F.concat(raw, F.lit("index"))).otherwise(raw)
    name = F.btrim(F.regexp_replace(raw, "[^a-zA-Z0-9._-]+", "_"), F.lit("_"))
    return F.substring(F.when(name.endswith(".html"), name).otherwise(F.concat(name, F.lit(".html"))), 1, 200)


def safe_name(c: Column | str, size: int = 120) -> Column:
    """Other characters become underscores, then cut to size, then none at the ends."""
    cut = F.substring(F.regexp_replace(col(c), "[^a-zA-Z0-9._-]+", "_"), 1, size)
    return F.coalesce(F.nullif(F.btrim(cut, F.lit("_")), F.lit("")), F.lit("untitled"))


def flat_path(c: Column | str) -> Column:
    """A path as one file name; nested_path() is its inverse."""
    return F.replace(col(c), F.lit("/"), F.lit("__"))


def nested_path(c: Column | str) -> Column:
    return F.replace(col(c), F.lit("__"), F.lit("/"))


def relative_path(c: Column | str, root: Column | str) -> Column:
    """The part of a path below root; null if it doesn't lie there."""
    base = F.concat(F.regexp_replace(col(root), "/+$", ""), F.lit("/"))
    return F.when(F.startswith(col(c), base), F.substring(col(c), F.length(base) + 1, F.length(col(c))))


def mail_day(c: Column | str) -> Column:
    """The day of an RFC 2822 date as written there, "0000-00-00" if it can't be read."""
    bare = F.regexp_extract(col(c), r"^(?:[A-Za-z]{3},\s*)?(\d{1,2} [A-Za-z]{3} \d{4}) \d{1,2}:\d{2}", 1)
    return F.coalesce(F.date_format(F.try_to_timestamp(bare, F.lit("d MMM yyyy")), "yyyy-MM-dd"), F.lit("0000-00-00"))


MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def parsed_day(c: Column | str, default_year: int) -> Column:
    """A date as 2026-03-04, 3/4, 3/4/26, 3/4/2026, Mar 4, March 4, 2026; without a year the default one, else null."""
    t = strip(c)
    part = lambda rx, k: F.nullif(F.regexp_extract(t, rx, k), F.lit("")).cast("int")
    iso, slash, named = r"^(20\d{2})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})/(\d{1,2})(?:/(\d{2,4}))?$", r"^([a-zA-Z]+)\.?\s+(\d{1,2})(?:,?\s*(20\d{2}))?$"
    two = lambda x, n: F.lpad(x.cast("string"), n, "0")
    day = lambda y, m, d: F.to_date(F.try_to_timestamp(F.concat_ws("-", two(y, 4), two(m, 2), two(d, 2)), F.lit("yyyy-MM-dd")))
    short = F.coalesce(part(slash, 3), F.lit(default_year))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(F.regexp_extract(t, named, 1), 1, 3))).cast("int")
    return F.coalesce(
        F.when(t.rlike(iso), day(part(iso, 1), part(iso, 2), part(iso, 3))),
        F.when(t.rlike(slash), day(F.when(short < 100, short + 2000).otherwise(short), part(slash, 1), part(slash, 2))),
        F.when(t.rlike(named) & (month > 0), day(F.coalesce(part(named, 3), F.lit(default_year)), month, part(named, 2))),
    )
