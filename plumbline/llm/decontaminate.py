"""Benchmark decontamination by latent semantic retrieval.

1. Every document becomes the sequence of its benchmark words (others are a gap). The
   TERMS rarest words of each item, by document frequency over the corpus, are the terms.
2. Passages are windows of WINDOW words. A randomised SVD of their TF-IDF rows is
   computed where the passages are: each task adds up its part of A'(A Omega), parts are
   summed by blocks of terms, and the driver orthonormalises a matrix of terms x rank.
   The benchmark's own rows carry as much weight as the corpus, so that an item that
   leaked once has its direction, too.
3. Passages are projected and compared with the projected items by cosine.
4. Candidates are checked on the words around them: a leak has a longest common
   subsequence of STRONG of the item, or of WEAK with the item's answer (its last
   ANSWER words) word for word, which finds paraphrases.
5. The terms and the cosine pass over some leaks, long items that lack their rarest words
   among them. The rest is found exactly: a leak may lack a quarter of the item, so some of
   any larger part of it, its rarest words, lie near each other; or the answer is there word
   for word. Such places go through the same checks, so a row is given for each item that
   the words around any window hold.

The benchmark is a reference set that fits on the driver; it is read in blocks of BLOCK
items, so what is broadcast is bounded: words of BLOCK items, BLOCK * TERMS x rank numbers.

Defined results: case and ASCII punctuation do not count; items of fewer than MIN_WORDS
words are passed over (any text may hold them); null texts are empty and hold nothing;
rows with one id are one document in the result; an empty table or benchmark gives no rows.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import keep, texts

WINDOW, STRIDE, TERMS, MIN_HITS, MIN_WORDS, BLOCK, EXTRA = 64, 24, 12, 2, 5, 200, 24
COSINE, STRONG, WEAK, ANSWER = 0.3, 0.75, 0.5, 5
#: Words of an item that must lie near each other in any leak; more make fewer places and more hits.
NEAR = 4
#: Words of a run of documents: its hits times the rank stay in a core's cache.
CHUNK, TERM_BLOCK = 1 << 12, 64
PUNCTUATION = string.punctuation.encode()
LEAKS = "doc_id bigint, item_id bigint, cosine double, lcs bigint, item_words bigint, answer boolean"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(None, PUNCTUATION).split()


@dataclass
class Items:
    """A block of the benchmark: item ids, their words as numbers, all words."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[bytes, int]


def read_items(benchmark: DataFrame) -> Iterator[Items]:
    rows = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("t IS NOT NULL").orderBy("i", "t").toLocalIterator()
    block: list[tuple[int, list[bytes]]] = []

    def items():
        vocabulary: dict[bytes, int] = {}
        return Items([i for i, _ in block], [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws], np.int64) for _, ws in block], vocabulary)

    for r in rows:
        if len(ws := words_of(r.t)) >= MIN_WORDS:
            block.append((r.i, ws))
        if len(block) == BLOCK:
            yield items()
            block = []
    if block:
        yield items()


def sequences(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, ids: numbers of the benchmark words, -1 for others, as packed 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = dict(shared.value)
        gap = [-1] * 10_000

        def number(words):
            return np.fromiter(map(find.get, words, gap if len(words) <= len(gap) else [-1] * len(words)), np.int32, len(words))

        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "ids": pa.array([number(words_of(t.as_py())).tobytes() for t in b.column("text")], pa.binary())})

    return texts(docs).mapInArrow(run, "doc_id bigint, ids binary")


def document_frequency(seqs: DataFrame, size: int) -> tuple[int, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(size + 1, np.int64), 0
        for b in batches:
            for x in b.column("ids"):
                df[np.unique(np.frombuffer(x.as_py(), np.int32))] += 1  # -1 counts in the last place
                n += 1
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"w": at, "n": df[at]})

    counts = seqs.select("ids").mapInArrow(run, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(size + 1, np.int64)
    df[counts["w"].to_numpy()] = counts["n"].to_numpy()
    return int(df[-1]), df[:-1]


@dataclass
class Terms:
    """term: number of the term of each word, -1 if none (the last entry is the gap); weight: of each term;
    alone: which terms are enough of an item for a cosine of COSINE without any other."""

    term: np.ndarray
    weight: np.ndarray
    rows: list[np.ndarray]  # the terms of each item, once for each occurrence
    alone: np.ndarray | None = None


def choose_terms(items: Items, n: int, df: np.ndarray) -> Terms:
    chosen = set()
    for w in items.words:
        own = np.unique(w)
        chosen.update(own[np.lexsort((own, df[own]))][:TERMS].tolist())
    term = np.full(len(df) + 1, -1, np.int64)
    at = np.array(sorted(chosen), np.int64)
    term[at] = np.arange(len(at))
    terms = Terms(term, np.log1p(n / np.maximum(df[at], 1)), [t[t >= 0] for t in (term[w] for w in items.words)])
    terms.alone = (item_rows(terms) >= COSINE).any(0)
    return terms


@dataclass
class Keys:
    """What no leak of an item lacks: ``need`` occurrences of its key words (count and first: their places in
    ``item``, by word; the last entry is the gap) within ``span`` words, or its answer, by the answer's rarest word."""

    count: np.ndarray
    first: np.ndarray
    item: np.ndarray  # i: a key word of item i; items + i: the rarest word of its answer
    need: np.ndarray
    span: np.ndarray
    answer: np.ndarray  # items x ANSWER
    at: np.ndarray  # place of the rarest word in the answer


def item_keys(items: Items, df: np.ndarray) -> Keys:
    words, owners, need, at = [], [], [], []
    answer = np.array([w[-ANSWER:] for w in items.words], np.int64).reshape(-1, ANSWER)
    for i, w in enumerate(items.words):
        own, n = np.unique(w, return_counts=True)
        order = np.lexsort((own, df[own]))
        total, spare = np.cumsum(n[order]), int(len(w) - np.ceil(STRONG * len(w)))
        k = min(int(np.searchsorted(total, spare + NEAR)), len(order) - 1) + 1
        need.append(int(total[k - 1]) - spare)
        at.append(int(np.argmin(df[answer[i]])))
        words += [*own[order[:k]].tolist(), int(answer[i, at[i]])]
        owners += [i] * k + [len(items.words) + i]
    word, owner = np.array(words, np.int64), np.array(owners, np.int64)
    order = np.argsort(word, kind="stable")
    count = np.append(np.bincount(word, minlength=len(df)), 0)
    span = np.array([WINDOW + 2 * (len(w) // 2) for w in items.words], np.int64)
    return Keys(count, np.cumsum(count) - count, owner[order], np.array(need, np.int64), span, answer, np.array(at, np.int64))


def places(ids: np.ndarray, offsets: np.ndarray, keys: Keys) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """document, item, first and last word, and whether it is the answer: for each place that may belong to a leak."""
    n_items = len(keys.need)
    count = keys.count[ids]
    hits = np.flatnonzero(count)
    count = count[hits]
    at = np.repeat(hits, count)
    item = keys.item[np.repeat(keys.first[ids[hits]] - np.cumsum(count) + count, count) + np.arange(len(at))]
    doc = np.repeat(np.searchsorted(offsets, hits, "right") - 1, count)
    told = item >= n_items
    a_item, a_doc = item[told] - n_items, doc[told]
    start = at[told] - keys.at[a_item]
    ok = (start >= offsets[a_doc]) & (start + ANSWER <= offsets[a_doc + 1])
    for c in range(ANSWER):
        a_item, a_doc, start = a_item[ok], a_doc[ok], start[ok]
        ok = ids[start + c] == keys.answer[a_item, c]
    a_item, a_doc, start = a_item[ok], a_doc[ok], start[ok]
    at, item, doc = at[~told], item[~told], doc[~told]
    group = doc * n_items + item
    order = np.argsort(group, kind="stable")
    at, item, doc, group = at[order], item[order], doc[order], group[order]
    last = np.arange(len(at)) + keys.need[item] - 1
    inside = np.flatnonzero(last < len(at))
    last = last[inside]
    ok = (group[last] == group[inside]) & (at[last] - at[inside] < keys.span[item[inside]])
    inside, last = inside[ok], last[ok]
    return (np.concatenate([doc[inside], a_doc]), np.concatenate([item[inside], a_item]), np.concatenate([at[inside], start]),
            np.concatenate([at[last], start + ANSWER - 1]), np.arange(len(inside) + len(start)) >= len(inside))


def stretches(ids: np.ndarray, offsets: np.ndarray, keys: Keys) -> list[tuple[int, int, bool, int, int]]:
    """document, item, whether for its answer, first and last window: the windows that have a place in reach."""
    doc, item, a, b, told = places(ids, offsets, keys)
    half, size = (keys.span[item] - WINDOW) // 2, offsets[doc + 1] - offsets[doc]
    a, b = a - offsets[doc], b - offsets[doc]
    most = np.maximum(size - WINDOW + STRIDE - 1, 0) // STRIDE
    low = np.minimum(np.maximum((b - half - WINDOW) // STRIDE + 1, 0), most)
    high = np.minimum((a + half) // STRIDE, most)
    ok = low <= high
    out: list[tuple[int, int, bool, int, int]] = []
    for d, i, t, lo, hi in sorted(zip(*(x[ok].tolist() for x in (doc, item, told, low, high)), strict=True)):
        if out and out[-1][:3] == (d, i, t) and lo <= out[-1][4] + 1:
            out[-1] = (d, i, t, out[-1][3], max(hi, out[-1][4]))
        else:
            out.append((d, i, t, lo, hi))
    return out


@dataclass
class Passages:
    """Hits (position, term) of many documents one after the other, and the windows with
    MIN_HITS hits or more, or with one that is enough: document, start, end, range of hits."""

    at: np.ndarray
    hit: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def passages(ids: np.ndarray, offsets: np.ndarray, terms: Terms) -> Passages:
    found = terms.term[ids]
    at = np.flatnonzero(found >= 0)
    sizes = np.diff(offsets)
    windows = np.where(sizes > 0, np.maximum(sizes - WINDOW + STRIDE - 1, 0) // STRIDE + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), windows)
    j = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = offsets[doc] + STRIDE * j
    end = np.minimum(start + WINDOW, offsets[doc + 1])
    lo, hi = np.searchsorted(at, start), np.searchsorted(at, end)
    ok = hi - lo >= MIN_HITS
    if terms.alone is not None and len(at):
        ok |= (hi > lo) & terms.alone[found[at[np.minimum(lo, len(at) - 1)]]]
    doc, start, end, lo, hi = doc[ok], start[ok], end[ok], lo[ok], hi[ok]
    inside = np.zeros(len(at) + 1, np.int64)  # hits of no window are left out
    np.add.at(inside, lo, 1)
    np.add.at(inside, hi, -1)
    kept = np.cumsum(inside)[:-1] > 0
    new = np.concatenate([[0], np.cumsum(kept)])
    return Passages(at[kept], found[at[kept]], doc, start, end, new[lo], new[hi])


def sums(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of rows lo .. hi-1."""
    total = np.zeros((len(rows) + 1, *rows.shape[1:]))
    np.cumsum(rows, axis=0, out=total[1:])
    return total[hi] - total[lo]


def normal_product(p: Passages, weight: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, their rows of A'(A basis)) for the rows A of these passages, scaled to length one."""
    if not len(p.doc):
        return np.zeros(0, np.int64), np.zeros((0, basis.shape[1]))
    w = weight[p.hit]
    y = sums(w[:, None] * basis[p.hit], p.lo, p.hi) / sums(w * w, p.lo, p.hi)[:, None]
    # The windows that hold a hit follow each other.
    first, last = np.searchsorted(p.end, p.at, "right"), np.searchsorted(p.start, p.at, "right")
    g = w[:, None] * sums(y, first, np.maximum(first, last))
    order = np.argsort(p.hit, kind="stable")
    cuts = np.flatnonzero(np.diff(p.hit[order], prepend=-1))
    return p.hit[order][cuts], np.add.reduceat(g[order], cuts)


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first document, words, offsets) for runs of documents."""
    held, size, first = [], 0, 0
    column = batch.column("ids")
    for i in range(len(column)):
        held.append(np.frombuffer(column[i].as_py(), np.int32))
        size += len(held[-1])
        if size >= CHUNK or i == len(column) - 1:
            yield first, np.concatenate(held), np.cumsum([0, *map(len, held)])
            held, size, first = [], 0, i + 1


def add_up(seqs: DataFrame, terms: Terms, basis: np.ndarray) -> tuple[int, np.ndarray]:
    """(number of passages, A'(A basis)) over the corpus."""
    shared = seqs.sparkSession.sparkContext.broadcast((terms, basis))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, basis = shared.value
        total, n = np.zeros((len(basis), basis.shape[1])), 0
        for b in batches:
            for _, ids, offsets in chunks(b):
                p = passages(ids, offsets, terms)
                t, rows = normal_product(p, terms.weight, basis)
                total[t] += rows
                n += len(p.doc)
        starts = range(0, len(basis), TERM_BLOCK)
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(list(starts), pa.int64()), "n": pa.array([n] * len(starts), pa.int64()), "part": pa.array([total[i:i + TERM_BLOCK].tobytes() for i in starts], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            for block, n, x in zip(*(b.column(c) for c in ("block", "n", "part")), strict=True):
                m, s = done.get(block.as_py(), (0, 0.0))
                done[block.as_py()] = (m + n.as_py(), s + np.frombuffer(x.as_py()))
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(list(done), pa.int64()), "n": pa.array([n for n, _ in done.values()], pa.int64()), "part": pa.array([s.tobytes() for _, s in done.values()], pa.binary())})

    schema = "block bigint, n bigint, part binary"
    rows = seqs.select("ids").mapInArrow(part, schema).repartition("block").mapInArrow(add, schema).toArrow().to_pylist()
    out = np.zeros_like(basis)
    for r in rows:
        block = np.frombuffer(r["part"]).reshape(-1, basis.shape[1])
        out[r["block"]:r["block"] + len(block)] = block
    return (rows[0]["n"] if rows else 0), out


def item_rows(terms: Terms) -> np.ndarray:
    """TF-IDF rows of the items, of length one."""
    out = np.zeros((len(terms.rows), len(terms.weight)))
    for i, t in enumerate(terms.rows):
        np.add.at(out[i], t, terms.weight[t])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def randomised_svd(seqs: DataFrame, terms: Terms, seed: int = 7) -> np.ndarray:
    """terms x rank: right singular vectors of the passages' TF-IDF rows, largest first."""
    q = item_rows(terms)
    rank = min(len(terms.weight), len(q) + EXTRA)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(terms.weight), rank)))[0]
    for _ in range(2):  # the range, then one subspace iteration
        n, product = add_up(seqs, terms, basis)
        product += max(1.0, n / len(q)) * (q.T @ (q @ basis))
        left, _, _ = np.linalg.svd(product, full_matrices=False)
        basis = left
    return basis


def common_subsequence(masks: dict[int, int], m: int, words: list[int]) -> int:
    """Length of the longest common subsequence with an item given by its words' bit masks."""
    full = (1 << m) - 1
    v = full
    for w in words:
        if mask := masks.get(w):
            u = v & mask
            v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def bit_masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def holds(words: list[int], part: list[int]) -> bool:
    n = len(part)
    return any(words[i:i + n] == part for i in range(len(words) - n + 1) if words[i] == part[0])


def search(seqs: DataFrame, items: Items, terms: Terms, basis: np.ndarray, keys: Keys) -> DataFrame:
    """The candidates by cosine, and the rest by their keys, that pass the checks on their words."""
    shared = seqs.sparkSession.sparkContext.broadcast((items.ids, items.words, terms, basis, keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_ids, words, terms, basis, keys = shared.value
        query = item_rows(terms) @ basis
        query /= np.maximum(np.linalg.norm(query, axis=1, keepdims=True), 1e-12)
        masks = [bit_masks(w) for w in words]
        weighted = terms.weight[:, None] * basis

        def around(ids, offsets, d, start, end, i):
            half = len(words[i]) // 2
            return ids[max(offsets[d], start - half):min(offsets[d + 1], end + half)].tolist()

        def cosine_of(passage, i):
            t = terms.term[passage]
            t = t[t >= 0]
            return float(weighted[t].sum(0) @ query[i] / np.sqrt((terms.weight[t] ** 2).sum())) if len(t) else 0.0

        def candidates(ids, offsets):
            """document, start, end, item of windows, and their cosine if it is known."""
            p = passages(ids, offsets, terms)
            known = set()
            if len(p.doc):
                w = terms.weight[p.hit]
                rows = sums(weighted[p.hit], p.lo, p.hi) / np.sqrt(sums(w * w, p.lo, p.hi))[:, None]
                cosine = rows @ query.T
                for k, i in zip(*np.nonzero(cosine >= COSINE), strict=True):
                    known.add((int(p.start[k]), int(i)))
                    yield int(p.doc[k]), int(p.start[k]), int(p.end[k]), int(i), float(cosine[k, i])
            for d, i, told, low, high in stretches(ids, offsets, keys):
                starts = range(offsets[d] + STRIDE * low, offsets[d] + STRIDE * high + 1, STRIDE)
                every = around(ids, offsets, d, starts[0], starts[-1] + WINDOW, i)
                if common_subsequence(masks[i], len(words[i]), every) >= (WEAK if told else STRONG) * len(words[i]):
                    for start in starts:
                        if (start, i) not in known:
                            known.add((start, i))
                            yield d, start, min(start + WINDOW, int(offsets[d + 1])), i, None

        for b in batches:
            best: dict[tuple[int, int], tuple] = {}
            for first, ids, offsets in chunks(b):
                for d, start, end, i, cosine in candidates(ids, offsets):
                    m = len(words[i])
                    near = around(ids, offsets, d, start, end, i)
                    lcs = common_subsequence(masks[i], m, near)
                    if lcs < WEAK * m:
                        continue
                    answer = holds(near, words[i][-ANSWER:].tolist())
                    if lcs >= STRONG * m or answer:
                        row = (lcs, answer, cosine_of(ids[start:end], i) if cosine is None else cosine)
                        best[first + d, i] = max(best.get((first + d, i), row), row)
            ids_of = b.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([ids_of[d] for d, _ in best], pa.int64()), "item_id": pa.array([item_ids[i] for _, i in best], pa.int64()),
                "cosine": pa.array([r[2] for r in best.values()], pa.float64()), "lcs": pa.array([r[0] for r in best.values()], pa.int64()),
                "item_words": pa.array([len(words[i]) for _, i in best], pa.int64()), "answer": pa.array([r[1] for r in best.values()], pa.bool_())})

    found = seqs.mapInArrow(run, LEAKS)
    return found.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("cosine", "lcs", "item_words", "answer")])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs, item_words, answer: a row for each item found in a document."""
    out = None
    for items in read_items(benchmark):
        seqs = keep(sequences(docs, items), "benchmark-words")
        n, df = document_frequency(seqs, len(items.vocabulary))
        terms = choose_terms(items, n, df)
        found = search(seqs, items, terms, randomised_svd(seqs, terms), item_keys(items, df))
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], LEAKS) if out is None else out


def remove_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found."""
    found = keep(leaks(docs, benchmark).select("doc_id").distinct(), "leaks")
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["doc_id"]), "left_anti")
