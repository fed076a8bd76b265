"""Periodic runs of words, found in a grammar of the text.

A run is a stretch of consecutive words with smallest period q and a length of at least
max(6, 4 q) that no neighbouring word extends keeping that period. Boilerplate, loops of
generated text and tables of one row repeated are such runs.

    found = find_runs(docs)     # doc_id, n_words, runs, strongest, collapsed

For each text:

1. *Stretches.* A word of a run occurs four times in it, so words that occur less often among
   the words around them end every run. What lies between, six words or more, goes on.
2. *Grammar.* Re-Pair: the most frequent pair of neighbouring symbols becomes a new symbol,
   until no pair occurs twice. The symbols left over are joined by a balanced tree.
3. *Crossing runs.* Each symbol stands for a pair; the runs of its expansion that cross the
   boundary of the pair are computed once, however often the symbol occurs. Every run of the
   text crosses the boundary of the smallest symbol around it, so none is lost.
4. *Translation.* Runs of a symbol are moved to all places where the derivation has it;
   intervals of one period that share a period of words are one run.

``runs`` is array<struct<start, length, period>> by start, then period (word numbers from 0);
``strongest`` is the run with the greatest exact length / period (ties: smallest start, then
period), or null; ``collapsed`` is the text's words without those that a run contains after
its first period, joined by one space.

Words are `[^\\x20\\x09-\\x0D]+`. Texts are judged whole, one row at a time, in one narrow
pass; memory is that of one text's words. Defined results: a null or blank text has no words,
no runs, and collapses to the empty string; repeated rows and ids are judged row by row; an
empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.llm.common import texts, utf8

MIN_LENGTH = 6
MIN_PERIODS = 4
#: Rounds of cutting stretches; a saving alone, the grammar takes any stretch.
ROUNDS = 6
#: Up to this many words are compared one by one before numpy takes over.
SHORT = 32

Run = tuple[int, int, int]  # start, end, period


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Where runs can lie: all words of a stretch occur at least MIN_PERIODS times in it,
    as far as ROUNDS of cutting show."""
    todo, out = [(0, len(ids), 0)], []
    while todo:
        lo, hi, turn = todo.pop()
        if hi - lo < MIN_LENGTH:
            continue
        if turn == ROUNDS:
            out.append((lo, hi))
            continue
        _, which, n = np.unique(ids[lo:hi], return_inverse=True, return_counts=True)
        cuts = np.flatnonzero(n[which] < MIN_PERIODS)
        if not len(cuts):
            out.append((lo, hi))
            continue
        edges = np.concatenate([[-1], cuts, [hi - lo]])
        for k in np.flatnonzero(np.diff(edges) > MIN_LENGTH):
            todo.append((lo + int(edges[k]) + 1, lo + int(edges[k + 1]), turn + 1))
    return out


def re_pair(seq: list[int]) -> tuple[list[tuple[int, int, int]], list[int], list[int]]:
    """(rules, symbols left, their places). Rule k makes symbol ``base + k`` of two symbols,
    base being max(seq) + 1; it holds (left, right, one place where it occurs)."""
    n, base = len(seq), max(seq) + 1
    s, after, before = list(seq), list(range(1, n + 1)), list(range(-1, n - 1))
    spots: dict[tuple[int, int], list[int]] = {}
    for i in range(n - 1):
        spots.setdefault((s[i], s[i + 1]), []).append(i)
    heap = [(-len(at), at[0], pair) for pair, at in spots.items() if len(at) > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int, int]] = []
    while heap:
        count, _, pair = heapq.heappop(heap)
        x, y = pair
        still = [i for i in spots[pair] if s[i] == x and after[i] < n and s[after[i]] == y]
        live, taken = [], -1
        for i in still:  # ascending; the second half of an occurrence starts none
            if i != taken:
                live.append(i)
                taken = after[i]
        if len(live) < -count:
            if len(live) > 1:
                spots[pair] = still
                heapq.heappush(heap, (-len(live), live[0], pair))
            else:
                del spots[pair]
            continue
        del spots[pair]
        new, fresh = base + len(rules), {}
        rules.append((x, y, live[0]))
        for i in live:
            j = after[i]
            k, a = after[j], before[i]
            s[i], s[j], after[i] = new, -1, k
            if a >= 0:
                fresh.setdefault((s[a], new), []).append(a)
            if k < n:
                before[k] = i
                fresh.setdefault((new, s[k]), []).append(i)
        for p, at in fresh.items():
            if len(at) > 1:
                spots[p] = at
                heapq.heappush(heap, (-len(at), at[0], p))
    symbols, places, i = [], [], 0
    while i < n:
        symbols.append(s[i])
        places.append(i)
        i = after[i]
    return rules, symbols, places


class Crossing:
    """Runs inside ``text[lo:hi]`` that cross a boundary, as that part alone has them."""

    def __init__(self, text: np.ndarray):
        self.array, self.list = text, text.tolist()

    def forward(self, i: int, p: int, hi: int) -> int:
        """The first place from i on that differs from the one p later (hi - p at most)."""
        t, stop = self.list, hi - p
        near = min(stop, i + SHORT)
        while i < near and t[i] == t[i + p]:
            i += 1
        if i < near or i >= stop:
            return i
        width = SHORT
        while i < stop:
            end = min(stop, i + width)
            other = np.flatnonzero(self.array[i:end] != self.array[i + p:end + p])
            if len(other):
                return i + int(other[0])
            i, width = end, 2 * width
        return stop

    def backward(self, i: int, p: int, lo: int) -> int:
        """The smallest place from which all up to i equal the one p later; i + 1 if i does not."""
        t = self.list
        near = max(lo, i - SHORT)
        while i >= near and t[i] == t[i + p]:
            i -= 1
        if i >= near or i < lo:
            return i + 1
        width = SHORT
        while i >= lo:
            end = max(lo, i - width + 1)
            other = np.flatnonzero(self.array[end:i + 1] != self.array[end + p:i + 1 + p])
            if len(other):
                return end + int(other[-1]) + 1
            i, width = end - 1, 2 * width
        return lo

    def periods(self, lo: int, b: int, hi: int) -> list[int]:
        """Periods that a run across b may have: its last word before b occurs a period
        later, or its first word from b on a period earlier."""
        most, t = (hi - lo) // MIN_PERIODS, self.list
        if most <= SHORT:
            x, y = t[b - 1], t[b]
            return [p for p in range(1, most + 1) if (b - 1 + p < hi and t[b - 1 + p] == x) or (b - p >= lo and t[b - p] == y)]
        later = np.flatnonzero(self.array[b:min(hi, b + most)] == t[b - 1]) + 1
        earlier = b - max(lo, b - most) - np.flatnonzero(self.array[max(lo, b - most):b] == t[b])
        return np.union1d(later, earlier).tolist()

    def runs(self, lo: int, b: int, hi: int) -> list[Run]:
        found: dict[tuple[int, int], int] = {}
        t = self.list
        for p in self.periods(lo, b, hi):
            # A run of a smaller period that covers p + q words on both sides of b: by the periodicity
            # lemma a run of period p would be that run, or give it a smaller period still.
            if any(s <= max(lo, b - p - q) and e >= min(hi, b + p + q) for (s, e), q in found.items()):
                continue
            at = []
            if b - 1 + p < hi and t[b - 1 + p] == t[b - 1]:
                at.append((self.backward(b - 1, p, lo), self.forward(b - 1, p, hi) + p))
            if b - p >= lo and t[b - p] == t[b] and not (at and at[0][0] <= b - p):
                at.append((self.backward(b - p, p, lo), self.forward(b - p, p, hi) + p))
            for s, e in at:
                if e - s >= max(MIN_LENGTH, MIN_PERIODS * p):
                    found.setdefault((s, e), p)  # periods ascend: the smallest stays
        return [(s, e, p) for (s, e), p in found.items()]


def _runs_of_stretch(part: np.ndarray) -> list[Run]:
    _, seq = np.unique(part, return_inverse=True)
    cross, seq = Crossing(seq), seq.tolist()
    base = max(seq) + 1
    rules, symbols, places = re_pair(seq)
    size = [1] * base
    for x, y, _ in rules:
        size.append(size[x] + size[y])
    own: dict[int, list[Run]] = {}
    for k, (x, y, at) in enumerate(rules):
        if size[base + k] >= MIN_LENGTH:
            runs = cross.runs(at, at + size[x], at + size[base + k])
            if runs:
                own[base + k] = [(s - at, e - at, p) for s, e, p in runs]
    out: list[Run] = []
    edges = [*places, len(seq)]
    todo = [(0, len(symbols))]
    while todo:  # the balanced tree over the symbols that are left
        i, j = todo.pop()
        if j - i > 1 and edges[j] - edges[i] >= MIN_LENGTH:
            mid = (i + j) // 2
            out += cross.runs(edges[i], edges[mid], edges[j])
            todo += [(i, mid), (mid, j)]
    if own:
        spots: list[list[np.ndarray]] = [[] for _ in rules]
        by_symbol: dict[int, list[int]] = {}
        for symbol, at in zip(symbols, places):
            if symbol >= base:
                by_symbol.setdefault(symbol, []).append(at)
        for symbol, at in by_symbol.items():
            spots[symbol - base].append(np.array(at))
        for k in range(len(rules) - 1, -1, -1):  # a symbol's parents come after it
            x, y, _ = rules[k]
            everywhere = np.concatenate(spots[k])
            spots[k] = []
            for s, e, p in own.get(base + k, ()):
                out += [(s + at, e + at, p) for at in everywhere.tolist()]
            if x >= base:
                spots[x - base].append(everywhere)
            if y >= base:
                spots[y - base].append(everywhere + size[x])
    return out


def merged(runs: list[Run]) -> list[Run]:
    """Maximal intervals: those of one period that share a period of words are one."""
    out: list[Run] = []
    for s, e, p in sorted(set(runs), key=lambda r: (r[2], r[0], r[1])):
        if out and out[-1][2] == p and s <= out[-1][1] - p:
            out[-1] = (out[-1][0], max(e, out[-1][1]), p)
        else:
            out.append((s, e, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_of(words: list) -> list[Run]:
    """All runs (start, end, period) of a list of words, by start, then period."""
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    out: list[Run] = []
    for lo, hi in stretches(ids):
        out += [(s + lo, e + lo, p) for s, e, p in merged(_runs_of_stretch(ids[lo:hi]))]
    return sorted(out, key=lambda r: (r[0], r[2]))


def analyse(text: str | None) -> dict:
    words = utf8(text).split()
    runs = runs_of(words)
    kept = words
    if runs:
        gone = np.zeros(len(words), bool)
        for s, e, p in runs:
            gone[s + p:e] = True
        kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
    rows = [{"start": s, "length": e - s, "period": p} for s, e, p in runs]
    best = max(rows, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"])) if rows else None
    return {"n_words": len(words), "runs": rows, "strongest": best, "collapsed": b" ".join(kept).decode("utf-8", "replace")}


FIELDS = ("start", "length", "period")
_RUN = T.StructType([T.StructField(f, T.LongType()) for f in FIELDS])
_ROW = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("strongest", _RUN), T.StructField("collapsed", T.StringType())])
_ARROW_RUN = pa.struct([(f, pa.int64()) for f in FIELDS])
_ARROW_ROW = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_ARROW_RUN)), ("strongest", _ARROW_RUN), ("collapsed", pa.string())])


@F.arrow_udf(_ROW)
def _analyse(text: pa.Array) -> pa.Array:
    return pa.array([analyse(x.as_py()) for x in text], _ARROW_ROW)


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs, strongest, collapsed: one row for each row of ``docs``."""
    return texts(docs, key, text).select("doc_id", _analyse("text").alias("m")).select("doc_id", "m.*")
