"""Plain Python versions of operators, by their definitions, for small tables."""

import datetime
import hashlib
import re

import numpy as np
import regex

from tesserae.llm import language, pii, toxicity

# --- pseudonyms ---


def prf(key, kind, *rest):
    return int(hashlib.sha256("|".join([key, kind, *map(str, rest)]).encode()).hexdigest()[:15], 16)


def feistel(value, a, b, key, kind):
    left, right = divmod(value, b)
    for i in range(1, pii.ROUNDS + 1):
        if i % 2:
            left = (left + prf(key, kind, i, right) % a) % a
        else:
            right = (right + prf(key, kind, i, left) % b) % b
    return left * b + right


def refill(shape, digits):
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


def luhn(digits, odd):
    total = 0
    for i, c in enumerate(reversed(digits), 1):
        d = int(c) * (2 if i % 2 == odd else 1)
        total += d - 9 if d > 9 else d
    return total


def card(m, key):
    d = re.sub("[^0-9]", "", m)
    if luhn(d, 0) % 10:
        return None
    n, half = len(d) - 2, (len(d) - 2) // 2
    payload = d[0] + str(feistel(int(d[1:-1]), 10 ** (n - half), 10**half, key, "card")).zfill(n)
    return refill(m, payload + str(-luhn(payload, 1) % 10))


def phone(m, key):
    d = re.sub("[^0-9]", "", m)
    area, exchange, line = int(d[-10:-7]), int(d[-7:-4]), int(d[-4:])
    if area >= 200 and exchange >= 200:
        x = feistel(((area - 200) * 800 + exchange - 200) * 10000 + line, 640000, 10000, key, "phone")
        out = f"{x // 8_000_000 + 200}{x // 10000 % 800 + 200}{x % 10000:04}"
    else:
        outside = [(a, e) for a in range(200) for e in range(1000)] + [(a, e) for a in range(200, 1000) for e in range(200)]
        x = feistel(outside.index((area, exchange)) * 10000 + line, 360000, 10000, key, "phone outside")
        out = "{:03}{:03}".format(*outside[x // 10000]) + f"{x % 10000:04}"
    return refill(m, ("1" if len(d) == 11 else "") + out)


def ipv4(m, key):
    parts = [int(x) for x in m.split(".")]
    if max(parts) > 255:
        return None
    x = feistel(int.from_bytes(bytes(parts)), 65536, 65536, key, "ipv4")
    return ".".join(str(b) for b in x.to_bytes(4))


def ssn(m, key):
    areas = [a for a in range(1, 900) if a != 666]
    area, group, serial = map(int, m.split("-"))
    if area not in areas or not group or not serial:
        return None
    x = feistel((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99, 9999, key, "ssn")
    return f"{areas[x // (99 * 9999)]:03}-{x // 9999 % 99 + 1:02}-{x % 9999 + 1:04}"


def years_of(y):
    """The block of years that a year lies in, in order."""
    if y < 200 or y >= 9800:
        return [*range(9800, 10000), *range(1, 200)]
    first = y - (y - 200) % 400
    return list(range(first, first + 400))


def dates_of(years):
    return [datetime.date(y, 1, 1) + datetime.timedelta(k) for y in years for k in range(366 if datetime.date(y, 12, 31).timetuple().tm_yday == 366 else 365)]


_DAYS = {}


def block_days(y):
    years = years_of(y)
    if years[0] not in _DAYS:
        days = dates_of(years)
        late = [x for x in days if x.day >= 13 and (x.month, x.day) != (2, 29)]
        _DAYS[years[0]] = days, {x: k for k, x in enumerate(days)}, late, {x: k for k, x in enumerate(late)}, [x for x in days if (x.month, x.day) == (2, 29)]
    return years, *_DAYS[years[0]]


def as_date(y, m, d):
    try:
        return datetime.date(y, m, d)
    except ValueError:
        return None


def ymd(m, key):
    day = as_date(int(m[:4]), int(m[5:7]), int(m[8:]))
    if day is None:
        return None
    years, days, at, *_ = block_days(day.year)
    a, b, kind = (5411, 27, "date") if len(years) == 400 else (1567, 93, "date edge")
    x = days[feistel(at[day], a, b, key, kind)]
    return f"{x.year:04}{m[4]}{x.month:02}{m[4]}{x.day:02}"


def dmy(m, key):
    one, two, y, mark = int(m[:2]), int(m[3:5]), int(m[6:]), m[2]
    write = lambda a, b, year: f"{a:02}{mark}{b:02}{mark}{year:04}"
    if y and 1 <= one <= 12 and 1 <= two <= 12:
        years = years_of(y)
        x = feistel(years.index(y) * 144 + (one - 1) * 12 + two - 1, len(years), 144, key, "date either way")
        return write(x // 12 % 12 + 1, x % 12 + 1, years[x // 144])
    day = as_date(y, two, one) if one > 12 else as_date(y, one, two)
    if day is None:
        return None
    years, _, _, late, place, leaps = block_days(y)
    if (day.month, day.day) == (2, 29):
        x = leaps[(leaps.index(day) + prf(key, "date leap day", 0) % 97) % len(leaps)]
    else:
        x = late[feistel(place[day], len(years), 221, key, "date late")]
    return write(x.day, x.month, x.year) if one > 12 else write(x.month, x.day, x.year)


def email(m, key):
    local, domain = m.split("@")
    half = (len(local) + 1) // 2
    left, right = local[:half], local[half:]

    def shifted(s, i, other):
        out = ""
        for k, c in enumerate(s, 1):
            by = int(hashlib.sha256("|".join([key, "email", str(i), other, str(k)]).encode()).hexdigest()[:8], 16)
            own = next((letters for letters in pii.CLASSES if c in letters), None)
            out += own[(own.index(c) + by) % len(own)] if own else c
        return out

    for i in range(1, pii.ROUNDS + 1):
        if i % 2:
            left = shifted(left, i, right)
        else:
            right = shifted(right, i, left)
    return f"{left}{right}@{domain}"


KINDS = [(pii.EMAIL, email), (pii.PHONE, phone), (pii.SSN, ssn), (pii.YMD, ymd), (pii.DMY.replace(r"\2", r"\1"), dmy), (pii.IPV4, ipv4), (pii.CARD, card)]


def pseudonym(m, key):
    """(text, number of replacements) of one candidate."""
    for rx, f in KINDS:
        if re.fullmatch(rx, m):
            new = f(m, key)
            return (m, 0) if new is None else (new, 1)
    return m, 0


def run_pieces(m, key):
    """A run of numbers: from each group on the longest valid card, else another candidate."""
    groups, out, n, i = re.findall("[0-9]+[ ./-]?", m), "", 0, 0
    while i < len(groups):
        size = 0
        for k in range(min(pii.CARD_GROUPS, len(groups) - i), 0, -1):
            t = re.sub("[ ./-]$", "", "".join(groups[i : i + k]))
            if re.fullmatch(pii.CARD, t) and luhn(re.sub("[^0-9]", "", t), 0) % 10 == 0:
                size = k
                break
        if not size:
            hit = re.match(pii.OTHER, "".join(groups[i : i + pii.OTHER_GROUPS]))
            size = len(re.findall("[0-9]+", hit[0])) if hit else 0
        value = "".join(groups[i : i + max(size, 1)])
        core = re.sub("[ ./-]$", "", value)
        new, hits = pseudonym(core, key) if size else (core, 0)
        out, n, i = out + new + value[len(core) :], n + hits, i + max(size, 1)
    return out, n


def pseudonymise(text, key):
    if text is None:
        return None, 0
    n = 0

    def replace(m):
        nonlocal n
        new, k = run_pieces(m[0], key) if re.fullmatch(pii.RUN, m[0]) else pseudonym(m[0], key)
        n += k
        return new

    return re.sub(pii.ANY, replace, text), n


# --- toxicity ---


def fold(text):
    low = (text or "").lower()
    if regex.search(r"[\p{Greek}\p{Cyrillic}ɡı０-ｚ]|\p{L}\p{M}*[0-9@$]+\p{L}|[0-9@$]\p{L}|\p{L}[0-9@]", low):
        low = " ".join(toxicity.unleet(w) for w in low.translate(toxicity.FOLD).split())
    return " " + regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", low).strip() + " "


def occurrences(text, key):
    return sum(text.startswith(key, k) for k in range(len(text)))


def toxicity_score(text, lexicon):
    t = fold(text)
    table = {}
    for entries, shape in ((lexicon.words, " {} "), (lexicon.stems, " {}"), (lexicon.exceptions, " {} ")):
        for k, w in entries.items():
            table[shape.format(k)] = table.get(shape.format(k), 0.0) + w
    weight = sum(w * occurrences(t, k) for k, w in table.items() if k in t)
    words = max(0, t.count(" ") - 1)
    level = max(weight, 0) / np.log2(2 + words / 50)
    return 1 / (1 + np.exp(-np.clip(lexicon.slope * level + lexicon.offset, -50, 50)))


# --- languages ---


def script_of(char):
    at = max(k for k, (start, _) in enumerate(language.SCRIPT_STARTS) if start <= ord(char))
    return language.SCRIPTS.index(language.SCRIPT_STARTS[at][1])


def words_of(text):
    return regex.findall(r"\p{L}[\p{L}\p{M}]*", (text or "").lower())


def word_scores(word, model):
    raw = f" {word}  ".encode()[: len(word.encode()) + 3]
    total = np.zeros(len(model.languages))
    for a, b, c in zip(raw[:-2], raw[1:], raw[2:], strict=False):
        h = (a * 0x9E3779B1 ^ b * 0x85EBCA6B ^ c * 0xC2B2AE35) % (1 << 32)
        total += model.logp[(h * 0x27D4EB2F % (1 << 32)) >> 16]
    return np.where(model.allowed[max(map(script_of, word))], total, total + language.RULED_OUT)


def best_labels(scores):
    """The labels of the best path, by trying each language before each word."""
    value, back = list(scores[0]), []
    for s in scores[1:]:
        top = int(np.argmax(value))
        came = [k if value[k] >= value[top] - language.SWITCH_PENALTY else top for k in range(len(s))]
        value = [max(value[k], value[top] - language.SWITCH_PENALTY) + s[k] for k in range(len(s))]
        back.append(came)
    out = [int(np.argmax(value))]
    for came in reversed(back):
        out.append(came[out[-1]])
    return out[::-1]
