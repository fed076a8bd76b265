"""Secrets in texts: patterns, and values of credential fields by guess cost.

Three patterns give the base spans (assignments, access keys, hexadecimal runs). The
values of credential fields are judged besides by how many guesses they would take: a
dynamic programme cuts the value into dictionary words, dates, repeats, keyboard walks
and single characters so that the total is least, and values above a threshold become
``guess`` spans. Placeholders such as "changeme" or "password123" stay below it.

Positions are code points, end exclusive. Defined results: a null text is empty and
has no spans; spans of one kind never overlap; kinds may overlap each other; the cost
of a value of n characters takes O(n) steps, so long values need no prefix rule.
"""

from __future__ import annotations

import re
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.llm.common import texts

KINDS = ("assign", "access", "hex", "guess")
FLAGS = re.ASCII | re.IGNORECASE
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", FLAGS)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Fields whose values are judged by guess cost, and what their values look like.
FIELD = re.compile(
    r"""(?:password|passwd|passphrase|pwd|secret|token|api_?key|credential|private_?key)["']?[\x20\t]*(?:[:=]|\x20is\x20)[\x20\t]*["']?([^\s"'<>,;]{6,})""",
    FLAGS)
HINTS = ("passw", "passphrase", "pwd", "secret", "token", "api", "credential", "private")

#: Words tried first, most common first.
WORDS = (
    "password pass admin welcome login user master letmein dragon monkey secret test changeme default root guest example"
    " hello summer winter spring autumn love star access shadow sun moon football baseball hunter super trust key token"
    " apple orange banana computer internet server database mysql oracle service system demo sample your my the and value here"
    " placeholder none null true false redacted hidden private public string text field name enter insert").split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST = max(map(len, WORDS))
#: Rows of a keyboard.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
LEET = str.maketrans({"@": "a", "4": "a", "3": "e", "0": "o", "$": "s", "5": "s", "!": "i", "1": "i", "7": "t"})
MIN_LOG10 = 9.0
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d")


def _neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for r, row in enumerate(ROWS):
        for i, c in enumerate(row):
            near.setdefault(c, set()).update(row[j] for j in (i - 1, i + 1) if 0 <= j < len(row))
            for other in (r - 1, r + 1):
                if 0 <= other < len(ROWS):
                    near[c].update(ROWS[other][j] for j in (i - 1, i, i + 1) if 0 <= j < len(ROWS[other]))
    return near


NEAR = _neighbours()


def char_cost(c: str) -> float:
    return 1.0 if c.isdigit() else log10(26) if c.isalpha() else log10(33)


def guess_cost(value: str) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses that the cheapest segmentation takes, and its segments
    (kind, start, end). Each segment costs a factor of two for where it begins."""
    n, low = len(value), value.lower()
    if len(low) != n:  # characters whose lower case is longer
        low = value
    plain = low.translate(LEET)
    step = log10(2)
    best: list[float] = [0.0] + [float("inf")] * n
    back: list[tuple[str, int]] = [("", 0)] * (n + 1)
    # runs of adjacent keys, and how far a repeat of a unit of 1 to 4 characters reaches
    walk = [1] * (n + 1)
    for i in range(n - 2, -1, -1):
        walk[i] = walk[i + 1] + 1 if low[i + 1] in NEAR.get(low[i], ()) else 1
    reach = {u: [0] * (n + 1) for u in range(1, 5)}
    for u, same in reach.items():
        for i in range(n - u - 1, -1, -1):
            same[i] = same[i + 1] + 1 if low[i] == low[i + u] else 0

    def offer(kind: str, i: int, j: int, cost: float) -> None:
        if best[i] + cost < best[j]:
            best[j], back[j] = best[i] + cost, (kind, i)

    for i in range(n):
        offer("brute", i, i + 1, char_cost(value[i]) + (0 if i and back[i][0] == "brute" else step))
        for j in range(i + 2, min(n, i + LONGEST) + 1):
            if rank := RANK.get(plain[i:j]):
                part = value[i:j]
                offer("word", i, j, log10(rank) + step * (1 + (part != part.lower()) + (low[i:j] != plain[i:j])))
        if low[i].isdigit() and (m := DATE.match(low, i)):
            offer("date", i, m.end(), log10(365 * 60 if m.end() - i > 4 else 120) + step)
        if walk[i] >= 3:
            offer("walk", i, i + walk[i], log10(40) + 0.35 * walk[i] + step)
        for u, same in reach.items():
            if (k := same[i] // u + 1) >= 2 and k * u >= 3:
                offer("repeat", i, i + k * u, sum(map(char_cost, low[i:i + u])) + log10(k) + step)
    cuts, j = [], n
    while j > 0:
        kind, i = back[j]
        cuts.append((kind, i, j))
        j = i
    return best[n], cuts[::-1]


def find(text: str | None, min_log10: float = MIN_LOG10) -> list[tuple[str, int, int]]:
    """(kind, start, end), by start, then kind."""
    text = text or ""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        out += [("guess", *m.span(1)) for m in FIELD.finditer(text) if guess_cost(m[1])[0] >= min_log10]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


@F.arrow_udf(T.ArrayType(T.StructType().add("kind", T.StringType()).add("start", T.LongType()).add("end", T.LongType())))
def secret_spans(text: pa.Array) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in find(x.as_py())] for x in text], SPANS)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans: one row for each row of ``docs``."""
    return texts(docs).select("doc_id", secret_spans("text").alias("spans"))


def redact(text, spans, mark: str = "*"):
    """Column: the text with every character of a span replaced (same length)."""
    inside = lambda i: F.exists(spans, lambda s: (s["start"] <= i) & (i < s["end"]))
    chars = F.transform(F.split(text, ""), lambda c, i: F.when(inside(i), F.lit(mark)).otherwise(c))
    return F.when(F.size(spans) > 0, F.concat_ws("", chars)).otherwise(text)
