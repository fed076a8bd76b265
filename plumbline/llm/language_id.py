"""Language identification: known words first, then shorter and shorter pieces of words.

A word that the model knows is scored by its log frequency in each language. A word that
it does not know is scored by its character n-grams: the longest order of which the model
knows at least one piece, as the mean of their log frequencies; where no piece is known
the word says nothing. The language with the greatest sum over all words of the text wins.

    model = fit(labelled)              # columns text, lang
    predict(docs, model)               # doc_id, lang_pred, score, n_words, n_known

Learning counts all words of all labelled rows: each task folds its words into a table
that it empties when it is full, Spark adds the tables up by (language, word), and pieces
are counted over distinct words, weighted by how often these occur. The model keeps what is
seen ``MIN_COUNT`` times and has, as a mean of its shares of each language, at least
``WORD_SHARE`` (words) or ``GRAM_SHARE`` (pieces of one order). Such shares add up to one, so
a model has at most 1 / WORD_SHARE words and ORDERS / GRAM_SHARE pieces, however large the
corpus and whichever language holds most of it: that is the proven bound of what is
collected and broadcast. Prediction is one narrow pass.

A word is a run of letters (as Unicode has it), in lower case. ``score`` is the winner's
share of the likelihood, all languages being as likely beforehand. Defined results: a text
that is null or has no letter is ``und`` with score 0; where nothing has been learned every
text is; a text of which no word says anything gets the language with most words (ties:
the first by name) with an even score; equal sums go to the first language by name; repeated rows and
ids are judged row by row; rows without a language teach nothing; an empty table gives
an empty table; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import keep, texts

ORDERS = 5
MIN_COUNT = 2
WORD_SHARE = 2e-6
GRAM_SHARE = 1e-5
SMOOTH = 0.1
#: Counts that a task holds before it hands them on; characters of texts that it judges at once.
HELD = 500_000
AT_ONCE = 4_000_000
UNKNOWN = "und"

RUN = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """The text's words, in order."""
    runs = RUN.findall((text or "").lower())
    if not runs or "".join(runs).isalpha():
        return runs
    # letters beside numerals such as ² or Ⅳ
    return [w for run in runs for w in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


def grams(word: str, order: int) -> list[str]:
    if order == 1:
        return list(word)  # the marks alone say nothing
    marked = f"^{word}$"
    return [marked[i:i + order] for i in range(len(marked) - order + 1)]


def _tables(counts: dict[tuple[str, str], int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["lang", "item", "n"])


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}
    size = 0
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
            mine = held.setdefault(lang, Counter())
            before = len(mine)
            mine.update(words(text.as_py()))
            size += len(mine) - before
            if size >= HELD:
                yield _tables({(k, w): n for k, c in held.items() for w, n in c.items()})
                held, size = {}, 0
    if size:
        yield _tables({(k, w): n for k, c in held.items() for w, n in c.items()})


def _count_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, dict[str, int]] = {}
    size = 0
    for b in batches:
        for lang, word, n in zip(b.column("lang").to_pylist(), b.column("item").to_pylist(), b.column("n").to_pylist()):
            mine = held.setdefault(lang, {})
            before = len(mine)
            for order in range(1, ORDERS + 1):
                for g in grams(word, order):
                    mine[g] = mine.get(g, 0) + n
            size += len(mine) - before
            if size >= HELD:
                yield _tables({(k, g): n for k, c in held.items() for g, n in c.items()})
                held, size = {}, 0
    if size:
        yield _tables({(k, g): n for k, c in held.items() for g, n in c.items()})


@dataclass
class Model:
    """Languages, their word totals, and a vector of log frequencies for each known word and piece."""

    langs: list[str]
    totals: list[int]
    known: dict[str, int]
    pieces: list[dict[str, int]]  # by order, from 1
    vectors: np.ndarray

    def unseen(self, words: list[str]) -> np.ndarray:
        """Vectors of words that are not known: means over the longest pieces that are."""
        out = np.zeros((len(words), len(self.langs)))
        left = list(range(len(words)))
        for order in range(ORDERS, 0, -1):
            find = self.pieces[order - 1].get
            at = [[i for g in grams(words[w], order) if (i := find(g)) is not None] for w in left]
            found = [k for k, x in enumerate(at) if x]
            if found:
                sizes = np.array([len(at[k]) for k in found])
                rows = self.vectors[[i for k in found for i in at[k]]]
                out[[left[k] for k in found]] = np.add.reduceat(rows, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
            left = [left[k] for k, x in enumerate(at) if not x]
        return out

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Languages, scores, numbers of words and of known words."""
        own: dict[str, int] = {}
        ids, sizes = [], []
        for text in texts:
            found = words(text)
            sizes.append(len(found))
            ids += [own.setdefault(w, len(own)) for w in found]
        n, n_texts = np.array(sizes, np.int64), len(texts)
        if not self.langs or not own:
            return [UNKNOWN] * n_texts, np.zeros(n_texts), n, np.zeros(n_texts, np.int64)
        vocabulary = list(own)
        at = np.fromiter((self.known.get(w, -1) for w in vocabulary), np.int64, len(vocabulary))
        vectors = self.vectors[np.maximum(at, 0)]
        new = np.flatnonzero(at < 0)
        if len(new):
            vectors[new] = self.unseen([vocabulary[i] for i in new])
        ids, text_of = np.array(ids, np.int64), np.repeat(np.arange(n_texts), n)
        total = np.stack([np.bincount(text_of, vectors[ids, k], n_texts) for k in range(len(self.langs))], axis=1)
        best = np.where(total.any(axis=1), total.argmax(axis=1), int(np.argmax(self.totals)))
        score = 1 / np.exp(total - total[np.arange(n_texts), best][:, None]).sum(axis=1)
        return (
            [self.langs[i] if k else UNKNOWN for i, k in zip(best, n)], np.where(n > 0, score, 0.0), n, np.bincount(text_of, at[ids] >= 0, n_texts).astype(np.int64))


def _vectors(items: DataFrame, totals: dict[str, int], share: float) -> tuple[list[str], np.ndarray]:
    """The items (lang, item, n) that the model keeps, and their log frequencies by language."""
    langs = sorted(totals)
    weight = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(1.0 / totals[k] / len(langs)))])
    kept = (
        items.groupBy("item").agg(F.sum("n").alias("n"), F.sum(F.col("n") * weight[F.col("lang")]).alias("share"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
        .where((F.col("n") >= MIN_COUNT) & (F.col("share") >= share)).select("item", F.transform(F.array(*map(F.lit, langs)), lambda k: F.coalesce(F.col("by")[k], F.lit(0))).alias("n"))
    ).toArrow()
    names = kept.column("item").to_pylist()
    n = np.asarray(kept.column("n").combine_chunks().flatten(), np.float64).reshape(len(names), len(langs))
    all_of = np.array([totals[k] for k in langs], np.float64)
    return names, np.log((n + SMOOTH) / (all_of + SMOOTH * (len(names) + 1)))


def fit(labelled: DataFrame) -> Model:
    """Learn from ``text`` and ``lang``; rows without a language are passed over."""
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counted = rows.mapInArrow(_count_words, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n"))
    counted = keep(counted, "language-words")
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # one row for each language
    if not totals:
        return Model([], [], {}, [{} for _ in range(ORDERS)], np.zeros((0, 0)))
    pieces = keep(counted.mapInArrow(_count_grams, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n")), "language-pieces")
    known, table = _vectors(counted, totals, WORD_SHARE)
    tables, by_order, place = [table], [], len(known)
    sums = {(r["order"], r["lang"]): r["n"] for r in pieces.groupBy(F.length("item").alias("order"), "lang").agg(F.sum("n").alias("n")).collect()}
    for order in range(1, ORDERS + 1):
        of = {k: sums[order, k] for k in totals if (order, k) in sums}
        of = {k: of.get(k, 1) for k in totals}  # no piece of this order: no word of that length
        names, table = _vectors(pieces.where(F.length("item") == order), of, GRAM_SHARE)
        by_order.append({g: place + i for i, g in enumerate(names)})
        place += len(names)
        tables.append(table)
    langs = sorted(totals)
    return Model(langs, [totals[k] for k in langs], {w: i for i, w in enumerate(known)}, by_order, np.concatenate(tables))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, n_words, n_known: one row for each row of ``docs``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, n_words long, n_known long")
    def judge(column: pa.Array) -> pa.Array:
        parts, held, size = [], [], 0
        for i, text in enumerate(column):
            held.append(text.as_py())
            size += len(held[-1] or "")
            if size >= AT_ONCE or i == len(column) - 1:
                parts.append(shipped.value.judge(held))
                held, size = [], 0
        names = ["lang_pred", "score", "n_words", "n_known"]
        if not parts:
            return pa.array([], pa.struct(list(zip(names, [pa.string(), pa.float64(), pa.int64(), pa.int64()]))))
        return pa.StructArray.from_arrays([pa.array([x for p in parts for x in p[0]]), *[pa.array(np.concatenate([p[i] for p in parts])) for i in (1, 2, 3)]], names=names)

    return texts(docs, key, text).select("doc_id", judge("text").alias("m")).select("doc_id", "m.*")
