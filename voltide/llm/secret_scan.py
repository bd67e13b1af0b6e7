"""Secret scan: fixed patterns, and values in a credential context judged by what it takes to guess them.

Fixed patterns find assignments of long plain values, access key ids and runs of hexadecimal digits. They miss values
that are short or hold other characters. So each value that stands where a password would is cut into words, dates,
repeats, keyboard walks and brute-force spans, by the dynamic program whose cost is the decimal logarithm of the
guesses for each part plus one constant per part. A value of at least ``THRESHOLD`` is reported as kind ``guess``, unless
it overlaps a fixed pattern, or is letters alone, capital at most in front, and so may be a word of prose.

Every text is scanned whole, in one pass without a shuffle; a task holds one batch. A pattern part has at most
``REACH`` characters (longer runs are several parts), so a value of n characters has n / REACH parts at least; one
whose constants alone reach the threshold needs no program.

Defined results: null or empty texts hold nothing; offsets are code points, ends exclusive; spans are ordered by start,
then kind; repeated rows each get theirs; extra columns pass through unless a column ``spans`` is there, which is replaced;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "guess")
SPANS = "spans array<struct<kind: string, start: int, end: int, log10_guesses: double>>"
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("log10_guesses", pa.float64())]))
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE = 12
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private)[_-]?key|credentials?|auth)["']?\x20*(?:[:=]|\x20is\x20)\x20*"""
                     r"""(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"'<>]+))""", re.ASCII | re.IGNORECASE)
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth")

THRESHOLD = 10.0
PART = log10(2)                  # each part's share of the number of arrangements
REACH = 64
LEAST_GUESSED = 6

# Words that passwords are made of, most common first.
WORDS = """password qwerty admin welcome monkey dragon letmein login master hello freedom whatever sunshine princess football
baseball superman batman trust hunter shadow michael jordan jennifer summer winter spring autumn secret test guest user root
default change changeme system server oracle access pass love secure computer internet hockey ranger thomas soccer killer
george charlie andrew daniel jessica pepper joshua maggie ginger cookie cheese orange banana apple purple yellow silver golden
tiger lion eagle falcon phoenix ninja mustang ferrari porsche mercedes honda toyota yankees cowboys lakers chelsea arsenal
liverpool london paris berlin madrid chicago dallas texas boston matrix starwars pokemon minecraft google facebook amazon
microsoft windows linux ubuntu android samsung example sample demo temp dummy foobar placeholder secretkey token apikey null
none true false abc xxx your here insert redacted hidden private public key correct horse battery staple money lucky angel
flower family friend forever january february march april june july august september october november december monday friday
sunday happy house""".split()
# Rows of keys, unshifted over shifted, and the alphabet, walked alike.
KEY_ROWS = (("`1234567890-=", "~!@#$%^&*()_+"), ("qwertyuiop[]\\", "QWERTYUIOP{}|"), ("asdfghjkl;'", 'ASDFGHJKL:"'), ("zxcvbnm,./", "ZXCVBNM<>?"))
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
# Look-alike characters.
LOOK_ALIKE = [str.maketrans("013457@$!", f"o{one}eastasi") for one in "il"]

RANK = {w: r for r, w in reversed(list(enumerate(WORDS, 1)))}
LONGEST_WORD = max(map(len, RANK))


def _keys() -> dict[tuple[str, str], str]:
    """Direction from each key to each neighbour. A row stands half a key to the right of the row above."""
    at = {c: (x, y) for y, rows in enumerate(KEY_ROWS) for row in rows for x, c in enumerate(row, 0 if y else -1)}
    steps = {(1, 0): "right", (-1, 0): "left", (0, 1): "down", (-1, 1): "down left", (0, -1): "up", (1, -1): "up right"}
    near = {(a, b): steps[d] for a, (x, y) in at.items() for b, (u, v) in at.items() if (d := (u - x, v - y)) in steps}
    for a, b in zip(ALPHABET, ALPHABET[1:]):
        near.setdefault((a, b), "forth")
        near.setdefault((b, a), "back")
    return near


NEIGHBOUR = _keys()
SHIFTED = set("".join(s for _, s in KEY_ROWS))


def brute(c: str) -> float:
    return log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100)


def word_parts(s: str) -> Iterator[tuple[int, int, str, float]]:
    for table in LOOK_ALIKE:
        plain = s.lower().translate(table) if len(s.lower()) == len(s) else s.translate(table)
        for i in range(len(s)):
            for j in range(i + 3, min(i + LONGEST_WORD, len(s)) + 1):
                rank = RANK.get(plain[i:j])
                if rank:
                    said = s[i:j]
                    changed = sum(not c.isalpha() for c in said)
                    capitals = sum(c.isupper() for c in said)
                    yield i, j, "word", log10(rank) + PART * (changed + (1 if capitals in (1, len(said)) and said[0].isupper() else capitals))


def _date(digits: list[str]) -> int | None:
    """The year that three fields say in some common order, or None."""
    for y, m, d in ((0, 1, 2), (2, 1, 0), (2, 0, 1)):
        if len(digits[y]) in (2, 4) and 1 <= int(digits[m]) <= 12 and 1 <= int(digits[d]) <= 31:
            year = int(digits[y])
            year += 0 if len(digits[y]) == 4 else 2000 if year < 50 else 1900
            if 1900 <= year <= 2100:
                return year
    return None


SPLITS = {8: ((4, 2, 2), (2, 2, 4)), 6: ((2, 2, 2),)}
WITH_MARKS = re.compile(r"(?=((\d{1,4})([-/._\x20])(\d{1,2})\3(\d{1,4})))", re.ASCII)


def date_parts(s: str) -> Iterator[tuple[int, int, str, float]]:
    span = lambda year: max(abs(year - 2000), 20)
    for i in range(len(s)):
        for n, splits in ((4, ()), *SPLITS.items()):
            text = s[i:i + n]
            if len(text) < n or not (text.isascii() and text.isdigit()):
                continue
            if n == 4 and 1900 <= int(text) <= 2100:
                yield i, i + 4, "date", log10(span(int(text)))
            for a, b, c in splits:
                year = _date([text[:a], text[a:a + b], text[a + b:]])
                if year:
                    yield i, i + n, "date", log10(365 * span(year))
    for m in WITH_MARKS.finditer(s):
        year = _date([m[2], m[4], m[5]])
        if year:
            yield m.start(1), m.end(1), "date", log10(365 * span(year)) + PART


def repeat_parts(s: str) -> Iterator[tuple[int, int, str, float]]:
    for unit in range(1, 9):
        least = 3 if unit == 1 else 2
        for i in range(len(s) - unit * least + 1):
            times, j = 1, i + unit
            while j + unit <= min(len(s), i + REACH) and s[j:j + unit] == s[i:i + unit]:
                times, j = times + 1, j + unit
                if times >= least:
                    yield i, j, "repeat", sum(map(brute, s[i:i + unit])) + log10(times)


def walk_parts(s: str) -> Iterator[tuple[int, int, str, float]]:
    for i in range(len(s) - 2):
        turns, way = 0, None
        for j in range(i + 1, min(i + REACH, len(s))):
            now = NEIGHBOUR.get((s[j - 1], s[j]))
            if now is None:
                break
            turns, way = turns + (now != way), now
            if j - i >= 2:
                yield i, j + 1, "walk", log10(47) + log10(j - i + 1) + (turns - 1) * log10(4) + PART * (s[i] in SHIFTED)


@lru_cache(maxsize=4096)
def guess_cost(s: str) -> tuple[float, list[tuple[int, int, str]]]:
    """(decimal logarithm of the guesses, parts) of the cheapest segmentation; among equal ones the first found."""
    ending: dict[int, list[tuple[int, str, float]]] = {}
    for find in (word_parts, date_parts, repeat_parts, walk_parts):
        for i, j, kind, cost in find(s):
            ending.setdefault(j, []).append((i, kind, cost))
    closed = [(0.0, 0, "")]                           # cheapest of s[:j] with its last part: (cost, where it begins, kind)
    opened = (float("inf"), 0)                        # the same with a brute-force part that may go on
    for j in range(1, len(s) + 1):
        opened = min((opened[0] + brute(s[j - 1]), opened[1]), (closed[j - 1][0] + PART + brute(s[j - 1]), j - 1))
        best = (opened[0], opened[1], "brute")
        for i, kind, cost in ending.get(j, ()):
            total = closed[i][0] + PART + cost
            if total < best[0]:
                best = (total, i, kind)
        closed.append(best)
    parts, j = [], len(s)
    while j:
        _, i, kind = closed[j]
        parts.append((i, j, kind))
        j = i
    return closed[-1][0], parts[::-1]


def prose(value: str) -> bool:
    return value.isalpha() and value[1:] == value[1:].lower()


def judged(value: str) -> float | None:
    """log10 of the guesses if the value is reported, else None. Infinity: above any cost that was worked out."""
    if len(value) < LEAST_GUESSED or prose(value):
        return None
    if len(value) >= REACH * ceil(THRESHOLD / PART):
        return float("inf")
    cost = guess_cost(value)[0]
    return cost if cost >= THRESHOLD else None


def scan_text(text: str) -> list[tuple[str, int, int, float | None]]:
    low = text.lower()
    found = []
    if any(h in low for h in HINTS):
        found += [("assign", *m.span(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [("access", *m.span(), None) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span(), None) for m in HEX.finditer(text)]
    if any(h in low for h in HINTS):
        taken, added = sorted((a, b) for _, a, b, _ in found), 0
        for m in CONTEXT.finditer(text):
            start, end = m.span(m.lastindex)
            value = m[m.lastindex]
            if m.lastindex == 3:
                value = value.rstrip(".,;:!?)]}")
                end = start + len(value)
            while added < len(taken) and taken[added][1] <= start:
                added += 1
            if any(a < end for a, _ in taken[added:added + 1]):
                continue
            cost = judged(value)
            if cost is not None:
                found.append(("guess", start, end, cost))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, plus spans."""
    kept = [c for c in docs.columns if c not in (text, "spans")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[dict(zip(("kind", "start", "end", "log10_guesses"), x)) for x in scan_text(t or "")] for t in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(spans, SPANS_ARROW)], [*kept, "spans"])

    wanted = docs.select(*kept, text)
    return wanted.mapInArrow(rows, T.StructType([*wanted.schema.fields[:-1], *T.StructType.fromDDL(SPANS).fields]))
