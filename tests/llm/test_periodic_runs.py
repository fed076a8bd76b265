"""Periodic runs against a search of all periods and starts."""

import random
import re
import zlib
from fractions import Fraction

import pytest

from plumbline.llm import periodic_runs
from plumbline.llm.queries import looped
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(6, 4 * q):
                found.setdefault((s, i + q), q)
            i = max(i, s + 1)
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def blocks(rng, letters, most):
    out = []
    for _ in range(rng.randint(1, 5)):
        out += [rng.randrange(letters) for _ in range(rng.randint(1, most))] * rng.randint(1, 8)
    return out


def nested(rng):
    b = [0]
    for _ in range(rng.randint(1, 6)):
        b = b + [rng.randrange(2)] + b if rng.random() < 0.5 else b + b
    return (b * rng.randint(1, 5))[:300]


@pytest.mark.parametrize("seed", range(4))
def test_runs_are_those_of_all_periods(seed):
    rng = random.Random(seed)
    for _ in range(400):
        words = [blocks(rng, 1 + seed, 6), blocks(rng, 40, 30), nested(rng), [rng.randrange(2 + seed) for _ in range(rng.randint(0, 90))]][rng.randrange(4)]
        if words and rng.random() < 0.3:
            words[rng.randrange(len(words))] = 99
        assert periodic_runs.runs_of(words) == brute(words), words


def test_grammar_derives_its_text_and_has_no_pair_twice():
    rng = random.Random(5)
    for _ in range(200):
        seq = blocks(rng, 3, 5)
        rules, symbols, places = periodic_runs.re_pair(seq)
        base = max(seq) + 1

        def derive(x):
            return [x] if x < base else derive(rules[x - base][0]) + derive(rules[x - base][1])

        assert sum((derive(x) for x in symbols), []) == seq
        for k, (_, _, at) in enumerate(rules):
            whole = derive(base + k)
            assert seq[at:at + len(whole)] == whole
        pairs = {}
        for i in range(len(symbols) - 1):
            pairs.setdefault(tuple(symbols[i:i + 2]), []).append(i)
        assert all(at[-1] - at[0] < 2 for at in pairs.values())


def test_long_texts_stay_quick():
    rng = random.Random(6)
    part = [rng.randrange(4000) for _ in range(5000)]
    assert periodic_runs.runs_of(part * 4) == [(0, 20000, 5000)]
    assert periodic_runs.runs_of([1] * 100_000) == [(0, 100_000, 1)]


def test_odd_rows(spark):
    for frame in (cases.odd(spark), cases.empty(spark)):
        want = sorted(((r.doc_id, r.text) for r in frame.collect()), key=repr)
        got = periodic_runs.find_runs(frame).collect()
        assert len(got) == len(want)
        expected = []
        for doc_id, text in want:
            words = WORD.findall(text or "")
            runs = brute(words) if len(words) < 1000 else [(0, len(words), 1)]
            gone = {i for s, e, q in runs for i in range(s + q, e)}
            best = max(runs, key=lambda r: (Fraction(r[1] - r[0], r[2]), -r[0], -r[2]), default=None)
            expected.append((doc_id, len(words), [(s, e - s, q) for s, e, q in runs], best and (best[0], best[1] - best[0], best[2]), " ".join(w for i, w in enumerate(words) if i not in gone)))
        assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest), r.collapsed) for r in got), key=repr) == sorted(expected, key=repr)


def test_looped_texts(spark):
    rows = [(i, " \n".join(f"w{i}x{j}" for j in range(i % 37)) + " ") for i in range(200)] + [(None, "a b"), (500, None)]
    for r in looped(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = dict(rows)[r.doc_id] or ""
        words, h = WORD.findall(text), zlib.crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if r.doc_id is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        assert WORD.findall(r.text) == words
