"""Text to records: splitters, interval and as-of lookups, scoring."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rulesets import EASY_WORDS, HARD_WORDS

# Marks of records in running text.
STRICT = re.compile(r"^\s*(?:problem|question|q|exercise|ex|#)?\s*(\d{1,2})[.\):]\s+", re.I | re.M)
LOOSE = re.compile(r"(?:^|\n)\s*(?:problem|question|q|exercise|ex|#)?\s*(\d{1,2})[.\):]\s+(?=[A-Z(])", re.I)
SHARED = re.compile(r"(?:assume|use|consider|refer\s+to)\b[^.\n]{0,80}?\b(?:question|problem)s?\s+(\d{1,2})\s*(?:-|–|—|to|through|thru)\s*(\d{1,2})", re.I)
BARE = re.compile(r"\n\s*(\d{1,2})[.\):]\s+")
TITLED = re.compile(r"(?:^|\n)\s*(?:(?:Problem|Question)\s+(\d{1,2})[:.]?\s+([^\n]{2,140})|(\d{1,2})\.\s+([A-Z][^\n]{4,140}))", re.I)
LISTED = re.compile(r"^[ \t]{0,3}(\d{1,2})[ \t]*\\?[.)][ \t]+(?=\S)", re.M)
WORTH = re.compile(r"\[\s*([\d.]+)\s*(?:pt|pts|point|points)\.?\s*\]", re.I)
RECORD = "num int, body string, start int"
PREAMBLE = "lo int, hi int, txt string, start int, end int"
TITLED_RECORD = "label string, body string"
LISTED_RECORD = "num int, body string, points double"


def between(text: str, starts: list[int], cuts: list[int], least: int, most: int) -> list[tuple[int, str]]:
    """(place in starts, body) from each start to the next cut, for bodies of least to most characters."""
    cuts = sorted({*cuts, len(text)})
    bodies = ((k, text[at : cuts[bisect_right(cuts, at)] if at < len(text) else at].strip()) for k, at in enumerate(starts))
    return [(k, body) for k, body in bodies if least <= len(body) <= most]


def record_spans(text: str) -> list[dict]:
    """Records from head to head, a shared introduction ending one as well; heads are strict ones, else loose ones.

    A body holds its head and has 31 to 5999 characters. Without any head the whole text is record 1."""
    heads = next((found for found in (list(rx.finditer(text)) for rx in (STRICT, LOOSE)) if found), None)
    if heads is None:
        return [{"num": 1, "body": text, "start": 0}]
    starts = [m.start() for m in heads]
    cuts = [*starts, *(m.start() for m in SHARED.finditer(text))]
    return [{"num": int(heads[k][1]), "body": body, "start": starts[k]} for k, body in between(text, starts, cuts, 31, 5999)]


def preamble_spans(text: str) -> list[dict]:
    """Ranges of records that share an introduction, from its marker on; reversed ranges and spans over 12 don't count.

    The text ends at the next numbered head (or 600 characters behind the marker), the region at the next head numbered
    hi + 1 (or 8000 characters behind the marker's start)."""
    places: dict[int | None, list[int]] = {}
    for head in BARE.finditer(text):
        for number in (None, int(head[1])):  # None: heads of any number
            places.setdefault(number, []).append(head.start())

    def after(number: int | None, at: int, default: int) -> int:
        own = places.get(number, [])
        k = bisect_left(own, at)
        return own[k] if k < len(own) else min(len(text), default)

    marks = ((m, int(m[1]), int(m[2])) for m in SHARED.finditer(text))
    return [
        {"lo": lo, "hi": hi, "txt": text[m.start() : after(None, m.end(), m.end() + 600)].strip(), "start": m.start(), "end": after(hi + 1, m.end(), m.start() + 8000)}
        for m, lo, hi in marks if 0 <= hi - lo <= 12
    ]


def titled_spans(text: str) -> list[dict]:
    """Records that begin with a number and a title, as "3. Title"; bodies of 80 to 8000 characters."""
    heads = list(TITLED.finditer(text))
    starts = [m.start() for m in heads]
    named = [(m[1] or m[3], (m[2] or m[4]).strip()[:80]) for m in heads]
    return [{"label": ". ".join(named[k]), "body": body} for k, body in between(text, starts, starts, 80, 8000)]


def longest_run(numbers: list[int]) -> list[int]:
    """Places of the longest subsequence 1, 2, 3 ..., the first of equals.

    One pass from the end: the run that begins at a number goes on with the nearest later run that begins one higher."""
    following, length, nearest = {}, {}, {}
    for k in range(len(numbers) - 1, -1, -1):
        following[k] = nearest.get(numbers[k] + 1)
        length[k] = 1 + length.get(following[k], 0)
        nearest[numbers[k]] = k
    ones = [k for k, n in enumerate(numbers) if n == 1]
    at, out = max(ones, key=lambda k: (length[k], -k), default=None), []
    while at is not None:
        out.append(at)
        at = following[at]
    return out


def numbered_run(text: str) -> list[dict]:
    """Numbered questions with points if named: the longest run of marks from 1 on, of at least two marks."""
    marks = list(LISTED.finditer(text))
    run = [marks[k] for k in longest_run([int(m[1]) for m in marks])]
    if len(run) < 2:
        return []
    bodies = [text[m.end() : end].strip() for m, end in zip(run, [*(m.start() for m in run[1:]), len(text)], strict=True)]
    worth = [WORTH.search(body) for body in bodies]
    return [{"num": int(m[1]), "body": body, "points": float(p[1]) if p else None} for m, body, p in zip(run, bodies, worth, strict=True)]


def graded_blocks(text: str) -> list[dict]:
    """Blocks headed by a number with a roman part and their score, as in "2.iv ... 3 / 5 pts"."""
    heads = list(re.finditer(r"^\s*(\d+)\.([ivx]+)\b", text, re.M))
    out = []
    for m, end in zip(heads, [*(h.start() for h in heads[1:]), len(text)], strict=False):
        block = text[m.end() : end]
        score = re.search(r"(\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)\s*pts?", block)
        if score:
            out.append({"label": f"{m[1]}.{m[2]}", "score": float(score[1]), "max_score": float(score[2]), "body": block.strip()})
    return out


def thin_captions(text: str, every: int = 15) -> str:
    """Keeps one time stamp of every so many caption lines, in front of the next line of speech."""
    pending, left, out = None, 0, []
    for line in text.split("\n"):
        line = line.strip()
        if re.fullmatch(r"\d{1,2}:\d{2}(?::\d{2})?", line):
            pending = line
        elif line:
            if pending and left <= 0:
                out.append(f"[{pending}] {line}")
                left = every
                pending = None
            else:
                out.append(line)
            left -= 1
    return "\n".join(out)


def packed(text: str, limit: int = 4500) -> list[str]:
    """Paragraphs, and sentences of paragraphs over the limit, packed into pieces of at most limit characters.

    A sentence over the limit stays whole."""
    units = []
    for p in (x.strip() for x in text.split("\n\n")):
        units += [p] if len(p) <= limit else re.split(r"(?<=[.!?])\s+", p)
    out: list[str] = []
    for u in filter(None, units):
        if out and len(out[-1]) + 2 + len(u) <= limit:
            out[-1] += "\n\n" + u
        else:
            out.append(u)
    return out


def split_rows(docs: DataFrame, split, schema: str, id_col: str = "doc", text_col: str = "text") -> DataFrame:
    """(id_col, place, columns of schema): a row for each record that split finds in a text."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    one = F.arrow_udf(lambda texts: pa.array([split(t) if t else [] for t in texts.to_pylist()], arrow_type(schema)), f"array<struct<{','.join(':'.join(c.split()) for c in schema.split(','))}>>")
    rows = docs.select(id_col, F.posexplode(one(text_col)).alias("place", "r"))
    return rows.select(id_col, "place", *[F.col("r")[n].alias(n) for n in names])


def arrow_type(schema: str) -> pa.DataType:
    types = {"int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    return pa.list_(pa.struct([(n, types[t]) for n, t in (c.split() for c in schema.split(","))]))


def sections(text: Column, heading: str) -> Column:
    """The body of a second-level Markdown section up to the next heading."""
    return F.regexp_extract(text, rf"(?s)##\s*{heading}[^\n]*\n(.*?)(?=\n##\s|\z)", 1)


def next_start(df: DataFrame, keys: list[str], start: str, length: str) -> DataFrame:
    """Adds end: where the next record of the same key starts, else the text's length."""
    return df.withColumn("end", F.coalesce(F.lead(start).over(Window.partitionBy(*keys).orderBy(start)), F.col(length)))


def first_interval(rows: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """rows (key, num, off) with the first range (key, pre_ord, lo, hi, start, end, txt) that holds num and off.

    An equi-join on key with the interval as a residual condition; the first range by pre_ord wins."""
    r = ranges.select(F.col(key).alias("_k"), "pre_ord", "lo", "hi", F.col("start").alias("_s"), F.col("end").alias("_e"), "txt")
    hit = rows.join(r, (rows[key] == r["_k"]) & rows["num"].between(r["lo"], r["hi"]) & (rows["off"] >= r["_s"]) & (rows["off"] < r["_e"]), "left")
    return hit.groupBy(*rows.columns).agg(F.min_by("txt", "pre_ord").alias("preamble"))


def as_of(rows: DataFrame, points: DataFrame, key: str, at: str, value: str, default: object) -> DataFrame:
    """rows with the value of the last point (key, at, value) not after the row's place, else the default.

    Rows and points are merged in one sorted pass per key: one shuffle, no row is paired with all earlier points."""
    extra = [c for c in rows.columns if c not in (key, at)]
    both = rows.withColumn(value, F.lit(None).cast(points.schema[value].dataType)).withColumn("_row", F.lit(1))
    marks = points.select(key, at, value, *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in extra]).withColumn("_row", F.lit(0))
    w = Window.partitionBy(key).orderBy(at, "_row").rowsBetween(Window.unboundedPreceding, 0)
    out = both.unionByName(marks).withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_row = 1")
    return out.withColumn(value, F.coalesce(value, F.lit(default))).drop("_row")


def difficulty(stem: Column, body_length: Column) -> Column:
    """0 to 10: the sum of weighted terms. Words weigh 1 or -1 each, lengths 1 a bound, parts and points up to a limit."""
    low = F.lower(stem)
    words = {1: HARD_WORDS, -1: EASY_WORDS}
    table = F.array(*[F.struct(F.lit(weight).alias("weight"), F.lit(w).alias("word")) for weight, ws in words.items() for w in ws])
    by_words = F.aggregate(F.filter(table, lambda t: low.contains(t["word"])), F.lit(0), lambda s, t: s + t["weight"])
    by_length = F.size(F.filter(F.array(F.lit(800), F.lit(1500)), lambda bound: body_length > bound))
    points = F.try_to_number(F.nullif(F.regexp_extract(low, r"\((\d{1,6})\s*points?\)", 1), F.lit("")), F.lit("999999")).cast("int")
    limited = [(F.regexp_count(low, F.lit(r"\([a-h]\)")) * 2, 4), (F.floor(F.coalesce(points, F.lit(0)) / 2), 3)]
    total = by_words + by_length + sum((F.least(value, F.lit(limit)) for value, limit in limited), F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(10), total)).cast("int")


def difficulty_label(score: Column) -> Column:
    return F.when(score <= 3, "easy").when(score <= 6, "medium").otherwise("hard")
