import random
import re

import pytest

from plumbline.llm import substring_dedup as sd
from tests.llm import cases


def brute(rows):
    docs = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    first, out = {}, {}
    for k, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for i in range(len(w) - 19):
            g = tuple(w[i:i + 20])
            if first.setdefault(g, (k, t, i)) != (k, t, i):
                gone |= set(range(i, i + 20))
        out[k, t] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return [out[r] for r in rows]


def check(spark, df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = sd.dedup_passages(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in got) == sorted(
        (k is None, k or 0, *x) for (k, _), x in zip(rows, brute(rows), strict=True))
    for r in got:
        assert sum(s.end - s.begin for s in r.removed) == r.n_removed


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcde", k=3)) for _ in range(rng.choice([6, 400]))]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [prose(rng.randrange(15, 90)) for _ in range(12)]
    texts = []
    for _ in range(120):
        w = prose(rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            p = list(rng.choice(passages))
            if rng.random() < .4:
                p[rng.randrange(len(p))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[rng.randrange(4):]
        texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    return texts + texts[:9]


@pytest.mark.parametrize("seed,hot", [(1, 20_000), (2, 20_000), (3, 4), (4, 4)])
def test_passages(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "SHARD", 40)
    check(spark, cases.docs(spark, corpus(seed)))


def test_automaton():
    rng = random.Random(5)
    for _ in range(60):
        texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(4, 25))] for _ in range(6)]
        a = sd.Automaton()
        order = rng.sample(range(6), 6)
        for i in order:
            a.add(texts[i], i << 32)
        a.close()
        for t in texts:
            for j, place in enumerate(a.earliest(t, 4)):
                assert place == min((i << 32) + p + 3 for i, x in enumerate(texts) for p in range(len(x) - 3) if x[p:p + 4] == t[j:j + 4])


def test_odd_documents(spark):
    check(spark, cases.odd(spark))
    assert sd.dedup_passages(cases.empty(spark)).count() == 0
