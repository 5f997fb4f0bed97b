"""Ordered rule lists as CASE expressions: the first rule that matches decides."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def first_rule(rules: list[tuple[Column, object]], default: object = None) -> Column:
    out = None
    for condition, label in rules:
        value = label if isinstance(label, Column) else F.lit(label)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


ASCII_WORD = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz")
#: With (?i) RE2 also takes these for the two letters; Java would only with flags that fold more than RE2 does.
FOLDED = {"s": "\u017f", "k": "\u212a"}


def java(rx: str) -> str:
    """An RE2 pattern (which the SQL uses) for Java: the same texts match.

    They differ in \\b (beside letters beyond ASCII), \\s (vertical tab), the dot (ends of lines other than \\n), $ (a last
    \\n) and (?i) (long s, Kelvin sign). Known are ASCII patterns with no flags but (?i) at the start."""
    fold = rx.startswith("(?i)")
    at, out = 4 * fold, ["(?i)"] * fold
    if not rx.isascii() or re.search(r"\(\?(?!:)|\\[BDPQWXpx]", rx[at:]):
        raise ValueError(f"no translation for {rx}")
    plain = lambda k: at <= k < len(rx) and rx[k] in ASCII_WORD and not (fold and rx[k].lower() in FOLDED)
    start = at
    while at < len(rx):
        c, two = rx[at], rx[at : at + 2]
        if c == "[":
            end = at + 1 + rx.startswith("^", at + 1)
            end += rx.startswith("]", end)
            while rx[end] != "]":
                end += 2 if rx[end] == "\\" else 1
            body = rx[at + 1 : end].replace(r"\s", r"\t\n\f\r ")
            held = re.compile("[" + body.removeprefix("^") + "]", re.IGNORECASE | re.ASCII)
            if body.endswith("-") and not body.endswith("\\-"):  # else a range with what follows
                body = body[:-1] + "\\-"
            out.append("[" + body + "".join(x for letter, x in FOLDED.items() if fold and held.match(letter)) + "]")
            at = end + 1
            continue
        if two == r"\b":
            before = rx[at - 1] if at > start else ""
            if plain(at + 2) and rx[at + 3 : at + 4] not in ("?", "*", "{"):
                out.append(r"(?<!\w)")
            elif before in ASCII_WORD and not (fold and before.lower() in FOLDED) and rx[at - 2 : at - 1] != "\\":
                out.append(r"(?!\w)")
            else:
                out.append(r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))")
        elif two in (r"\s", r"\S"):
            out.append(r"[\t\n\f\r ]" if two == r"\s" else r"[^\t\n\f\r ]")
        elif two == r"\w" and fold:
            out.append(r"[\w" + "".join(FOLDED.values()) + "]")
        elif c == "\\":
            out.append(two)
        elif c == ".":
            out.append(r"[^\n]")
        elif c == "$":
            out.append(r"\z")
        else:
            out.append(f"[{c}{FOLDED[c.lower()]}]" if fold and c.lower() in FOLDED else c)
        at += 2 if c == "\\" else 1
    return "".join(out)


def regex_case(rules: list[tuple[str, str]], *subjects: Column, default: str | None = "other") -> Column:
    """Rules (RE2 pattern, label) in order over the first subject, then over the next, then the default."""
    return F.coalesce(*[first_rule([(s.rlike(java(rx)), label) for rx, label in rules]) for s in subjects], F.lit(default))


def text_case(rules: list[tuple[str, str]], subject: Column, default: str | None = "other") -> Column:
    """The same as regex_case over one subject, in Arrow's RE2: for whole texts, in whose long lines Java may backtrack for minutes.

    All patterns are looked for at once; one by one only in the texts that hold any."""
    whole = "|".join(f"(?:{rx})" for rx, _ in rules)

    def labels(texts: pa.Array) -> pa.Array:
        held = pc.fill_null(pc.match_substring_regex(texts, whole), False)
        some = texts.filter(held)
        found = pa.nulls(len(some), pa.string())
        for rx, label in reversed(rules):
            found = pc.if_else(pc.match_substring_regex(some, rx), label, found)
        return pc.replace_with_mask(pa.nulls(len(texts), pa.string()) if default is None else pa.repeat(default, len(texts)), held, found)

    return F.arrow_udf(labels, "string")(subject)


def any_of(c: Column, words) -> Column:
    """Whether the text holds one of the words."""
    return reduce(lambda a, w: a | c.contains(w), words, F.lit(False))


def all_of(c: Column, patterns) -> Column:
    """Whether every pattern occurs in the text."""
    return reduce(lambda a, rx: a & c.rlike(rx), patterns, F.lit(True))


def ends_with_any(c: Column, suffixes) -> Column:
    return reduce(lambda a, s: a | c.endswith(s), suffixes, F.lit(False))


def quoted(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def sql_case(rules: list[tuple[str, str]], subject: str) -> str:
    """The same list as SQL, for checks in other engines."""
    return "CASE " + " ".join(f"WHEN regexp_matches({subject}, {quoted(rx)}) THEN {quoted(label)}" for rx, label in rules) + " END"


def sql_any(subject: str, words, how: str = "contains") -> str:
    return "(" + " OR ".join(f"{how}({subject}, {quoted(w)})" for w in words) + ")"
