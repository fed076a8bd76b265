"""Removal of repeated passages with suffix automata.

A window is WINDOW consecutive words of a document; the words of every window that also
starts earlier in the corpus (by doc_id, nulls last, then place) are removed. Windows
are judged on the input.

A window is known by its anchor: the five-word shingle in it with the smallest hash,
which equal windows share. The windows of one document with one anchor overlap; they
form a context of 20 to 35 words.

1. Anchors are counted over the corpus; windows whose anchor occurs once are unique.
2. Contexts of the other anchors are dealt to shards by their anchor. A context that a
   task has seen before is a copy and goes at once; each task sends the first of each.
   Anchors in very many documents are dealt window by window, so that no shard has to
   hold all that surrounds them.
3. Each shard builds the suffix automaton of its distinct contexts, a bounded number,
   with the earliest place of every state, and streams the contexts through it: the
   state of the last WINDOW words tells where they first ended.

Documents thus meet the one shard that can hold a window of theirs, instead of every
shard being broadcast to every document, which would cost their product.

Defined results: words are `[^\\x20\\x09-\\x0D]+`, unchanged; null texts have none; rows
with the same id and text are one document and change alike, rows with one id and
different texts are ordered by a hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import keep, texts, utf8
from plumbline.llm.token_index import runs

WINDOW, GRAM = 20, 5
#: Anchors that a task counts at a time; contexts of a shard and of a task; size of the table of repeated anchors.
BUCKET, SHARD, HELD, CACHE, FLUSH, SLOTS = 1_000_000, 4000, 100_000, 300_000, 1 << 20, 1 << 26
#: An anchor in more places than this, and in more than a 2^-20 share of all, is dealt window by window.
HOT = 20_000
NO_ID = np.iinfo(np.int64).max


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE:
            self[word] = h
        return h


def anchors(words: list[bytes], known: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, end of windows) for the runs of windows that share an anchor."""
    n = len(words)
    if n < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    with np.errstate(over="ignore"):
        g = np.zeros(n - GRAM + 1, np.uint64)
        for j in range(GRAM):
            g = g * np.uint64(0x9E3779B97F4A7C55) + h[j:n - GRAM + 1 + j]
        g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(32)
    inside = np.lib.stride_tricks.sliding_window_view(g, WINDOW - GRAM + 1)
    at = inside.argmin(axis=1) + np.arange(len(inside))
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return g[at[first]], first, np.append(first[1:], len(at))


def anchor_counts(docs: DataFrame, chars: int) -> DataFrame:
    """anchor, places: for anchors in two places or more. Anchors travel packed."""
    buckets = max(1, chars // 50 // BUCKET)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = Words(), [], 0

        def out():
            a = np.concatenate(held)
            bucket = (a % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(bucket[order])) + 1).tolist(), len(order)]
            parts = [order[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
            packed = []
            for p in parts:
                v, c = np.unique(a[p], return_counts=True)
                packed.append((int(bucket[p[0]]), v.tobytes(), c.astype("<i4").tobytes()))
            return pa.RecordBatch.from_pydict({
                "bucket": pa.array([x[0] for x in packed], pa.int64()), "anchors": pa.array([x[1] for x in packed], pa.binary()), "n": pa.array([x[2] for x in packed], pa.binary())})

        for b in batches:
            for t in b.column("text"):
                held.append(anchors(utf8(t.as_py()).split(), known)[0])
                size += len(held[-1])
                if size > FLUSH:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, "bucket"):
            a = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in rows["anchors"]])
            n = np.concatenate([np.frombuffer(x.as_py(), "<i4") for x in rows["n"]])
            v, at = np.unique(a, return_inverse=True)
            total = np.bincount(at, n, len(v)).astype(np.int64)
            twice = total > 1
            yield pa.RecordBatch.from_pydict({"anchor": v[twice].view(np.int64), "places": total[twice]})

    packed = texts(docs).select("text").mapInArrow(send, "bucket bigint, anchors binary, n binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "anchor bigint, places bigint")


def slot_table(counts: DataFrame) -> np.ndarray:
    """SLOTS bits, packed: those of the repeated anchors. Built in pieces by tasks; if it
    fills up at some scale, unique windows are sent, too, and found to be unique."""
    per = 1 << 15

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, rows in runs(batches, "piece"):
            bits = np.zeros(per, bool)
            bits[rows["slot"].to_numpy() % per] = True
            yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    slot = F.col("anchor").bitwiseAND(F.lit(SLOTS - 1).cast("long"))
    slots = counts.select(slot.alias("slot")).distinct().withColumn("piece", F.shiftrightunsigned("slot", 15))
    table = slots.repartition("piece").sortWithinPartitions("piece").mapInArrow(fill, "piece bigint, bits binary").toArrow()
    out = np.zeros(SLOTS // 8, np.uint8)
    for piece, bits in zip(table["piece"].to_pylist(), table["bits"], strict=True):
        out[piece * per // 8:(piece + 1) * per // 8] = np.frombuffer(bits.as_py(), np.uint8)
    return out


CONTEXTS = "shard bigint, context binary, no_id boolean, doc_id bigint, text_hash bigint, start bigint, windows bigint"


def contexts(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """The first place of each context that a task meets (shard, context, place), and
    the later ones (no context: all their windows are copies)."""
    places, n = counts.agg(F.coalesce(F.sum("places"), F.lit(0)), F.count("*")).first()
    shards = max(1, int(places) // SHARD)
    hot = counts.where(F.col("places") > max(HOT, int(places) >> 20)).select("anchor").toArrow()["anchor"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast((slot_table(counts), set(hot.view(np.uint64).tolist())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bits, hot), known = shared.value, Words()
        first: dict[bytes, tuple] = {}  # context -> shard and place
        again: list[tuple] = []

        def copy(no_id, k, h, start, windows):
            """Copies need no shard; those that follow each other in a document are one row."""
            if again and again[-1][1:4] == (no_id, k, h) and again[-1][4] + again[-1][5] == start:
                _, _, _, _, start, before = again.pop()
                windows += before
            again.append(((h ^ start) % shards, no_id, k, h, start, windows))

        def place(shard, context, at):
            if (old := first.get(context)) is None:
                first[context] = (shard, *at)
            elif old[1:5] < at[:4]:
                copy(*at)
            elif old[1:5] > at[:4]:
                copy(*old[1:])
                first[context] = (shard, *at)

        def out():
            rows = [(*v, c) for c, v in first.items()] + [(*v, None) for v in again]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            first.clear()
            again.clear()
            long = pa.int64()
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], long), pa.array(cols[6], pa.binary()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], long), pa.array(cols[3], long), pa.array(cols[4], long), pa.array(cols[5], long)],
                names=["shard", "context", "no_id", "doc_id", "text_hash", "start", "windows"])

        for b in batches:
            for k, h, t in zip(b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist(), b.column("text"), strict=True):
                words = utf8(t.as_py()).split()
                a, begin, end = anchors(words, known)
                slot = (a & np.uint64(SLOTS - 1)).astype(np.int64)
                some = np.flatnonzero((bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1)
                doc = (k is None, NO_ID if k is None else k, h)
                for anchor, i, j in zip(a[some].tolist(), begin[some].tolist(), end[some].tolist(), strict=True):
                    if anchor in hot:
                        for w in range(i, j):
                            context = b" ".join(words[w:w + WINDOW])
                            place(xxhash.xxh3_64_intdigest(context) % shards, context, (*doc, w, 1))
                    else:
                        place(anchor % shards, b" ".join(words[i:j + WINDOW - 1]), (*doc, i, j - i))
                if len(first) + len(again) > HELD:
                    yield out()
        yield out()

    d = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    return d.mapInArrow(run, CONTEXTS)


class Automaton:
    """Suffix automaton of several word sequences; each state knows the earliest place
    (any integer) where its words end."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.place = [-1], [0], [NO_ID]

    def state(self, length: int, place: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.place.append(place)
        return len(self.length) - 1

    def split(self, p: int, word: bytes, q: int) -> int:
        """The state of the words that lead from p to q, apart from q's longer ones."""
        c = self.state(self.length[p] + 1, self.place[q])
        self.next[c], self.link[c], self.link[q] = dict(self.next[q]), self.link[q], c
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        return c

    def add(self, words: list[bytes], place: int) -> None:
        """``place``: of the first word; later words count up."""
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for at, word in enumerate(words, place):
            q = nxt[last].get(word)
            if q is not None:  # known as a continuation already
                last = q if length[q] == length[last] + 1 else self.split(last, word, q)
                self.place[last] = min(self.place[last], at)
                continue
            p, last = last, self.state(length[last] + 1, at)
            while p >= 0 and word not in nxt[p]:
                nxt[p][word] = last
                p = link[p]
            if p >= 0:
                q = nxt[p][word]
                link[last] = q if length[q] == length[p] + 1 else self.split(p, word, q)

    def close(self) -> None:
        """Hand the earliest places on to suffixes."""
        place, link = self.place, self.link
        for s in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            if place[s] < place[link[s]]:
                place[link[s]] = place[s]

    def earliest(self, words: list[bytes], window: int) -> list[int]:
        """For each window of words that the automaton holds: where it first ended."""
        nxt, link, length, place = self.next, self.link, self.length, self.place
        out, s = [], 0
        for i, word in enumerate(words, 1):
            s = nxt[s][word]
            if i >= window:
                u = s
                while length[link[u]] >= window:
                    u = link[u]
                out.append(place[u])
        return out


def copies(found: DataFrame) -> DataFrame:
    """no_id, doc_id, text_hash, begin, end: runs of windows that start earlier elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, "shard"):
            cols = {c: rows[c].to_pylist() for c in ("context", "no_id", "doc_id", "text_hash", "start", "windows")}
            at = list(zip(*(cols[c] for c in ("no_id", "doc_id", "text_hash", "start", "windows")), strict=True))
            out = [a for a, c in zip(at, cols["context"], strict=True) if c is None]
            first: dict[bytes, tuple] = {}
            for a, c in zip(at, cols["context"], strict=True):
                if c is None:
                    continue
                if (old := first.get(c)) is None or a < old:
                    if old is not None:
                        out.append(old)
                    first[c] = a
                elif a != old:
                    out.append(a)
            rank = {d: i for i, d in enumerate(sorted({a[:3] for a in first.values()}))}
            automaton, split = Automaton(), {c: c.split(b" ") for c in first}
            for c, a in first.items():
                automaton.add(split[c], rank[a[:3]] << 32 | a[3])
            automaton.close()
            for c, a in first.items():
                own = (rank[a[:3]] << 32 | a[3]) + WINDOW - 1
                held = None
                for j, e in enumerate(automaton.earliest(split[c], WINDOW)):
                    if e < own + j:
                        held = j if held is None else held
                    elif held is not None:
                        out.append((*a[:3], a[3] + held, j - held))
                        held = None
                if held is not None:
                    out.append((*a[:3], a[3] + held, a[4] - held))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.bool_()), *[pa.array(c, pa.int64()) for c in cols[1:4]], pa.array([a + n for a, n in zip(cols[3], cols[4], strict=True)], pa.int64())],
                names=["no_id", "doc_id", "text_hash", "begin", "end"])

    return found.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "no_id boolean, doc_id bigint, text_hash bigint, begin bigint, end bigint")


def dedup_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by one space), removed (spans of
    words, end exclusive): a row for each row of ``docs``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept, spans = [], [], [], []
            for t, begin, end in zip(*(b.column(c) for c in ("text", "begin", "end")), strict=True):
                words = utf8(t.as_py()).split()
                gone = np.zeros(len(words) + 1, np.int64)
                if begin.is_valid:
                    np.add.at(gone, np.array(begin.as_py()), 1)
                    np.add.at(gone, np.array(end.as_py()) + WINDOW - 1, -1)
                gone = np.append(np.cumsum(gone)[:-1] > 0, False)
                edges = np.flatnonzero(np.diff(gone, prepend=False))
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=False) if not g] if len(edges) else words))
                spans.append([{"begin": int(x), "end": int(y)} for x, y in edges.reshape(-1, 2)])
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                "kept": pa.array(kept, pa.binary()).cast(pa.string()), "removed": pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))})

    chars = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    counts = keep(anchor_counts(docs, int(chars)), "anchors")
    gone = copies(contexts(docs, counts)).groupBy("no_id", "doc_id", "text_hash").agg(F.collect_list("begin").alias("begin"), F.collect_list("end").alias("end"))
    own = texts(docs).select("doc_id", "text", F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(int(NO_ID))).alias("key"), F.xxhash64("text").alias("text_hash"))
    joined = own.join(gone.withColumnRenamed("doc_id", "key"), ["no_id", "key", "text_hash"], "left").select("doc_id", "text", "begin", "end")
    return joined.mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept string, removed array<struct<begin:bigint,end:bigint>>")
