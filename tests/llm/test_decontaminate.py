import random

import numpy as np
import pytest

from plumbline.llm import decontaminate as dc
from plumbline.llm.queries import QUERIES
from tests.llm import cases

SF = "/root/testdata/sf0.01"


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        assert dc.common_subsequence(dc.bit_masks(np.array(a)), len(a), b) == plain_lcs(a, b)


def test_normal_product_and_svd(spark):
    """Against dense matrices: the sums of the tasks, and the span of the singular vectors."""
    rng = np.random.default_rng(2)
    ids = [rng.integers(-1, 30, n).astype(np.int32) for n in (0, 5, 64, 65, 200, 33)]
    terms = dc.Terms(np.append(np.where(np.arange(30) % 2, -1, np.arange(30) // 2), -1), rng.random(15) + .5, [np.array([0, 1, 2]), np.array([5, 6])])
    offsets = np.cumsum([0, *map(len, ids)])
    p = dc.passages(np.concatenate(ids), offsets, terms)
    dense = []
    for x in ids:
        for s in range(0, max(len(x) - 64 + 23, 0) // 24 * 24 + 1, 24):
            t = terms.term[x[s:s + 64]]
            t = t[t >= 0]
            if len(t) > 1:
                row = np.bincount(t, terms.weight[t], 15)
                dense.append(row / np.sqrt((terms.weight[t] ** 2).sum()))
    dense = np.array(dense)
    assert len(p.doc) == len(dense)
    basis = rng.random((15, 4))
    t, rows = dc.normal_product(p, terms.weight, basis)
    want = dense.T @ dense @ basis
    assert np.allclose(rows, want[t]) and np.allclose(np.delete(want, t, 0), 0)
    seqs = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(ids)], "doc_id long, ids binary")
    n, total = dc.add_up(seqs, terms, basis)
    assert n == len(dense) and np.allclose(total, want)
    v = dc.randomised_svd(seqs, terms)
    assert np.allclose(v.T @ v, np.eye(v.shape[1]))
    q = dc.item_rows(terms)
    assert (np.linalg.norm(q @ v, axis=1) > .95).all()


def test_op10_finds_whole_items(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    joined = lambda t: b" " + b" ".join(dc.words_of(t)) + b" "
    texts = {d.doc_id: joined(d.text) for d in docs}
    want = {(d, i.item_id) for i in items for d, t in texts.items() if joined(i.text) in t and len(dc.words_of(i.text)) >= dc.MIN_WORDS}
    got = {(r.doc_id, r.item_id): r for r in QUERIES["op10_decontaminate"](spark, SF).collect()}
    assert want and want <= got.keys()
    by_item = {i.item_id: dc.words_of(i.text) for i in items}
    for (d, i), r in got.items():  # and everything found does hold most of the item in order
        assert plain_lcs(by_item[i], dc.words_of(next(x.text for x in docs if x.doc_id == d))) >= r.lcs >= dc.WEAK * len(by_item[i])


def test_paraphrases_and_clean_documents(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=5))
    common = [word() for _ in range(30)]
    prose = lambda n: [rng.choice(common) if rng.random() < .5 else word() for _ in range(n)]
    items = [prose(40) for _ in range(30)]
    docs, want = [], set()
    for k in range(120):
        body = prose(rng.randrange(30, 400))
        if k % 2:
            i, at = rng.randrange(30), rng.randrange(len(body))
            leak = list(items[i])
            if k % 3 == 0:  # a third of the words changed, the answer kept
                for j in rng.sample(range(35), 14):
                    leak[j] = word()
            body[at:at] = leak
            want.add((k, i))
        docs.append(" ".join(body))
    items.append(["too", "short"])
    b = spark.createDataFrame([(i, " ".join(x).upper() + "?") for i, x in enumerate(items)] + [(99, None), (98, "")], "item_id long, text string")
    d = cases.docs(spark, docs)
    assert {(r.doc_id, r.item_id) for r in dc.leaks(d, b).collect()} == want
    left = dc.remove_leaking(d, b)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == set(range(0, 120, 2))


def test_paraphrases_of_real_items(spark):
    """Half of the words changed, the answer kept, planted into documents of the same corpus."""
    rng = random.Random(4)
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = [(r.item_id, dc.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    long = [(i, w) for i, w in items if len(w) >= 12]
    docs, want = [(r.doc_id, r.text) for r in rows], set()
    for k in range(4 * len(long)):
        i, w = long[k % len(long)]
        leak = list(w)
        for j in rng.sample(range(len(w) - dc.ANSWER), len(w) // 2):
            leak[j] = b"changed%d" % rng.randrange(10**6)
        if plain_lcs(leak, w) >= dc.WEAK * len(w):
            body = rng.choice(rows).text.split(" ")
            body.insert(rng.randrange(len(body) + 1), b" ".join(leak).decode())
            docs.append((10**9 + k, " ".join(body)))
            want.add((10**9 + k, i))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    got = {(r.doc_id, r.item_id) for r in dc.leaks(d, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert len(want) > 100 and len(want - got) <= .005 * len(want)


def test_one_rare_term_is_enough():
    """A window with one hit is a passage where that hit alone reaches the least cosine."""
    items = dc.Items([1], [np.arange(12)], {b"%d" % i: i for i in range(12)})
    terms = dc.choose_terms(items, 1000, np.array([1] + [400] * 11))
    ids = np.full(300, -1, np.int32)
    ids[[10, 290]] = 0, 5
    p = dc.passages(ids, np.array([0, 300]), terms)
    assert p.hit.tolist() == [terms.term[0]] and len(p.doc) == 1
    assert len(terms.weight) == dc.TERMS  # however frequent: a paraphrase may keep any of them
    ids[[100, 110, 120, 130]] = 8, 9, 10, 11
    p = dc.passages(ids, np.array([0, 300]), terms)
    assert set(terms.term[8:12]) <= set(p.hit.tolist())


@pytest.mark.parametrize("blocks", [200, 2])
def test_odd_documents(spark, monkeypatch, blocks):
    monkeypatch.setattr(dc, "BLOCK", blocks)
    b = spark.createDataFrame([(1, cases.PROSE), (2, "one two three four five six"), (3, "alpha beta gamma delta epsilon"), (3, "zeta eta theta iota kappa")], "item_id long, text string")
    d = cases.odd(spark)
    assert {(r.doc_id, r.item_id) for r in dc.leaks(d, b).collect()} == {(r.doc_id, 1) for r in d.collect() if r.text and "lazy dog" in r.text}
    assert dc.leaks(cases.empty(spark), b).count() == 0 and dc.leaks(d, b.limit(0)).count() == 0


def test_products_are_made_of_small_runs():
    """Arrays of hits times the rank left the cache; small runs must add up to the same products."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    sequences = [rng.integers(-1, 40, 500).astype(np.int32) for _ in range(60)]
    batch = pa.RecordBatch.from_pydict({"ids": pa.array([x.tobytes() for x in sequences], pa.binary())})
    terms = dc.Terms(np.append(np.arange(40), -1), rng.random(40) + 1, [])
    basis = rng.standard_normal((40, 8))
    total, largest = np.zeros((40, 8)), 0
    for _, ids, offsets in dc.chunks(batch):
        t, rows = dc.normal_product(dc.passages(ids, offsets, terms), terms.weight, basis)
        total[t] += rows
        largest = max(largest, len(ids))
    t, whole = dc.normal_product(dc.passages(np.concatenate(sequences), np.arange(0, 30_001, 500), terms), terms.weight, basis)
    assert largest < 5_000 and np.allclose(total[t], whole)


def plain_leaks(docs, items):
    """(document, item): lcs and answer over the words around every window, by the definition alone."""
    out = {}
    for d, x in enumerate(docs):
        for i, w in enumerate(items):
            for s in range(0, max(len(x) - dc.WINDOW + dc.STRIDE - 1, 0) // dc.STRIDE * dc.STRIDE + 1, dc.STRIDE):
                near = x[max(0, s - len(w) // 2):min(len(x), min(s + dc.WINDOW, len(x)) + len(w) // 2)]
                lcs, answer = plain_lcs(w, near), dc.holds(near, w[-dc.ANSWER:])
                if lcs >= dc.STRONG * len(w) or lcs >= dc.WEAK * len(w) and answer:
                    out[d, i] = max(out.get((d, i), (0, False)), (lcs, answer))
    return out


def test_leaks_without_the_rarest_words(spark):
    """A leak may lack all terms of a long item; every item that the words around a window hold is found."""
    rng = random.Random(9)
    common = [f"c{i}" for i in range(60)]
    items, docs = [], []
    for i in range(8):
        rare = [f"r{i}x{j}" for j in range(15)]
        w = rng.sample(common, 45) + rare
        rng.shuffle(w)
        if i % 2:  # the answer is made of common words
            w = [x for x in w if x not in rare[:10]] + rng.sample(common, 5)
        items.append(w)
    for k in range(40):
        body = [f"d{k}x{j}" if rng.random() < .5 else rng.choice(common) for j in range(rng.randrange(20, 200))]
        w = items[k % 8]
        rare = [x for x in w if x[0] == "r"]
        gone = set(rare if k % 3 else rng.sample(rare, 5)) | (set(rng.sample(common, 20)) if k % 5 == 0 else set())
        at = rng.randrange(len(body))
        body[at:at] = [x for x in w[:-dc.ANSWER] if x not in gone] + w[-dc.ANSWER:]
        docs.append(body)
    want = plain_leaks(docs, items)
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    d = cases.docs(spark, [" ".join(x) for x in docs])
    found = {(r.doc_id, r.item_id): (r.lcs, r.answer) for r in dc.leaks(d, b).collect()}
    assert len(want) > 30 and found == want


def test_keys_are_never_missing():
    """Places are given for every leak, also where words repeat, at the ends of documents, and in short items."""
    rng = np.random.default_rng(3)
    words = [rng.integers(0, 25, n) for n in (5, 6, 9, 20, 47, 64, 90)]
    items = dc.Items(list(range(len(words))), words, {b"%d" % i: i for i in range(25)})
    keys = dc.item_keys(items, rng.integers(1, 9, 25))
    ids = []
    for k in range(60):
        w = words[k % len(words)]
        left = w[np.sort(rng.permutation(len(w))[:int(np.ceil(dc.STRONG * len(w)))])]
        ids.append(np.concatenate([np.full(rng.integers(0, 120), -1), left, np.full(rng.integers(0, 120), -1)]).astype(np.int32))
    offsets = np.cumsum([0, *map(len, ids)])
    found = {(d, i, k) for d, i, _, lo, hi in dc.stretches(np.concatenate(ids), offsets, keys) for k in range(lo, hi + 1)}
    held = 0
    for d, x in enumerate(ids):
        i = d % len(words)
        w, half = words[i], len(words[i]) // 2
        for k in range(max(len(x) - dc.WINDOW + dc.STRIDE - 1, 0) // dc.STRIDE + 1):
            near = x[max(0, dc.STRIDE * k - half):min(len(x), min(dc.STRIDE * k + dc.WINDOW, len(x)) + half)].tolist()
            if plain_lcs(w.tolist(), near) >= dc.STRONG * len(w):
                held += 1
                assert (d, i, k) in found
    assert held > 60
