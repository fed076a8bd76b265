"""Token ids in raw binary shards, with a minimal perfect hash index by document key.

Files below one folder (any file system that pyarrow can open, shared by all
executors):

* ``*.ids``: a shard, holding documents in ascending key order: all ids, little-endian
  unsigned 16 or 32-bit integers, then one 64-bit offset for each document and one for
  the end, then width, number of documents and a magic number;
* ``*.mph``: one part of the index. A key's part is a hash; within the part a minimal
  perfect hash (levels of bit arrays, a key stays at the first level where nothing
  collides with it) gives its slot, without probing. A slot stores a 32-bit
  fingerprint of the key, the ordinal of its first document and how many it has;
* ``shards``, ``parts``: Parquet tables with one row for each file.

A lookup reads one slot and two offsets: constant time, whatever the size. Unknown
keys are refused by their fingerprint (all but one of 2^32).

Defined results: a null text is empty, so that it has just the end id; documents with
one key are neighbours, ordered by a hash of their text, and the key finds them all; a
null key is a key like others and comes first; an empty table gives no shard and no
part. Each task writes files under names of its own and reports them in the row that
the Parquet commit makes visible, so tasks can be repeated.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.common import texts, utf8

MAGIC, GAMMA, LEVELS, KEYS_PER_PART, ROWS = 0x31534449, 1.5, 48, 1 << 16, 1 << 16
TABLE_SIZE = 500_000


# -- encoding -----------------------------------------------------------------------------------------------------------

class WordTable:
    """Ids of distinct words, for tokenizers that drop white space and never merge
    across it. Where the tokenizer says that it changes nothing, words are lower-cased
    and cut from commas and stops first, so that more of them are known already."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        size = self.t.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 1 << 16 else 4
        self.type = np.dtype("<u2" if self.width == 2 else "<u4")
        whole = lambda x: self.t.encode(x, add_special_tokens=False).ids
        self.by_word = whole("ab c\n\td.  éx!") == sum(map(whole, ["ab", "c", "d.", "éx!"]), [])
        self.no_case = self.by_word and whole("QuÉ AB") == whole("quÉ ab") and all(whole(f"ab{m} b{m}c") == whole("ab") + whole(m) + whole("b") + whole(m + "c") for m in ",.")
        # Words of letters alone are one piece for the model: no normalizer or splitter has to run.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.byte_chars = {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}
        letters = [c for c in map(chr, range(256)) if c.isalpha() and c == c.lower()]
        self.plain = self.no_case and all(self.merged(w.encode()) == whole(w) for w in ["".join(letters), "the", "ing", *letters])
        self.table: dict[bytes, bytes] = {}

    def pack(self, ids: list[int]) -> bytes:
        return np.asarray(ids, self.type).tobytes()

    def merged(self, word: bytes) -> list[int]:
        text = word.decode() if word.isascii() else "".join(map(self.byte_chars.__getitem__, word))
        return [t.id for t in self.t.model.tokenize(text)]

    def words(self, text: str) -> list[bytes]:
        """White-space separated parts that make up the same ids. Only Latin-1 texts
        are lower-cased (in A-Z): there, nothing composes differently in lower case.
        A text that may hold the string of a special token is left as it is."""
        raw = utf8(text)
        if not self.no_case or b"<|" in raw or not is_latin(text):
            return raw.split()
        return MARKS.sub(b" ", raw.lower()).split()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. New words of all texts are encoded together."""
        if not self.by_word:
            return [self.pack(self.t.encode(x, add_special_tokens=False).ids) for x in texts]
        docs, table = [self.words(x) for x in texts], self.table
        new = set().union(*docs).difference(table)
        if len(table) + len(new) > TABLE_SIZE:
            table.clear()
            new = set().union(*docs)
        other = []
        for w in new:
            if self.plain and (w.isalpha() and w.islower() or not w.isascii() and latin_letters(w)):
                table[w] = self.pack(self.merged(w))
            else:
                other.append(w)
        whole = self.t.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in other], add_special_tokens=False)
        table.update((w, self.pack(e.ids)) for w, e in zip(other, whole, strict=True))
        return [b"".join(map(table.__getitem__, words)) for words in docs]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


#: The place between a letter and a comma or stop behind it.
MARKS = re.compile(rb"(?<=[a-z])(?=[.,])")


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def latin_letters(word: bytes) -> bool:
    text = word.decode("utf-8", "surrogatepass")
    return text.isalpha() and max(text) <= "\xff" and text == text.lower()


@lru_cache(maxsize=2)
def word_table(path: str) -> WordTable:
    return WordTable(path)


# -- files --------------------------------------------------------------------------------------------------------------

def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def own_name(stem: str, ending: str) -> str:
    return f"{stem}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.{ending}"


def groups(text: pa.Array, size: int = 1 << 20) -> Iterator[list[str]]:
    """The texts in runs of about a million characters."""
    held, n = [], 0
    for x in text:
        held.append(x.as_py() or "")
        n += len(held[-1])
        if n > size:
            yield held
            held, n = [], 0
    if held:
        yield held


def splitmix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (splitmix(keys, 1000) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: slots 0 .. n-1."""

    def __init__(self, levels: list[np.ndarray], sizes: list[int]):
        self.levels, self.sizes = levels, sizes
        counts = [np.bitwise_count(b).astype(np.int64) for b in levels]
        firsts = np.cumsum([0, *[int(c.sum()) for c in counts]])
        self.ranks = [np.concatenate([[0], np.cumsum(c)[:-1]]) + f for c, f in zip(counts, firsts, strict=False)]
        self.n = int(firsts[-1])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, sizes, left = [], [], keys
        while len(left):
            if len(levels) == LEVELS:
                raise ValueError("keys of one index part are not distinct")
            m = max(64, -(-int(GAMMA * len(left)) // 64) * 64)
            h = (splitmix(left, len(levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(h, minlength=m) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(m)
            left = left[~alone[h]]
        return cls(levels, sizes)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """-1 for a key that no level holds; other unknown keys get some slot."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, (bits, m, ranks) in enumerate(zip(self.levels, self.sizes, self.ranks, strict=True)):
            if not len(left):
                break
            h = splitmix(keys[left], k) % np.uint64(m)
            word, bit = (h >> np.uint64(6)).astype(np.int64), h & np.uint64(63)
            has = (bits[word] >> bit) & np.uint64(1) == 1
            below = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[has]] = (ranks[word] + np.bitwise_count(below))[has]
            left = left[~has]
        return out


def part_bytes(keys: np.ndarray, first: np.ndarray, count: np.ndarray, null: tuple[int, int]) -> bytes:
    mph = PerfectHash.build(keys)
    slot = mph.slots(keys)
    table = np.zeros(mph.n, np.dtype([("print", "<u4"), ("first", "<u8"), ("count", "<u8")]))
    table["print"][slot], table["first"][slot], table["count"][slot] = fingerprint(keys), first, count
    head = np.array([MAGIC, mph.n, len(mph.sizes), *null, *mph.sizes], "<i8")
    return b"".join([head.tobytes(), *[b.tobytes() for b in mph.levels], table.tobytes()])


class Part:
    def __init__(self, raw: bytes):
        magic, n, levels, *null = np.frombuffer(raw, "<i8", 5).tolist()
        if magic != MAGIC:
            raise ValueError("not an index part")
        sizes, at, bits = np.frombuffer(raw, "<i8", levels, 40).tolist(), 40 + 8 * levels, []
        for m in sizes:
            bits.append(np.frombuffer(raw, "<u8", m // 64, at))
            at += m // 8
        self.mph, self.null = PerfectHash(bits, sizes), null
        self.table = np.frombuffer(raw, np.dtype([("print", "<u4"), ("first", "<u8"), ("count", "<u8")]), n, at)

    def find(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ordinal of the first document, number of documents: 0 for unknown keys)."""
        nulls = keys.is_null().to_numpy(zero_copy_only=False)
        k = keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        slot = self.mph.slots(k)
        if self.mph.n:
            row = self.table[np.maximum(slot, 0)]
            known = (slot >= 0) & (row["print"] == fingerprint(k))
            first, count = row["first"].astype(np.int64), np.where(known, row["count"].astype(np.int64), 0)
        else:
            first = count = np.zeros(len(k), np.int64)
        return np.where(nulls, self.null[0], first), np.where(nulls, self.null[1], count)


# -- writing ------------------------------------------------------------------------------------------------------------

def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None, shards: int) -> None:
    """Tokenize, write shards in key order, and one row of ``entries`` per document."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(tokenizer)
        end = table.pack([] if end_id is None else [end_id])
        at, name, out, where = [0], own_name("shard", "ids"), None, place(folder)
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                out = where[0].open_output_stream(f"{where[1]}/{name}")
            first = len(at) - 1
            for group in groups(b.column("text")):
                for ids in table.encode_all(group):
                    out.write(ids + end)
                    at.append(at[-1] + (len(ids) + len(end)) // table.width)
            n = b.num_rows
            yield pa.RecordBatch.from_pydict({
                "file": pa.array([name]).take(pa.array(np.zeros(n, np.int64))), "doc_id": b.column("doc_id"),
                "row": np.arange(first, first + n), "n_tokens": np.diff(np.array(at[first:], np.int64))})
        if out is not None:
            out.write(np.array(at, "<i8").tobytes())
            out.write(np.array([table.width, len(at) - 1, MAGIC], "<i8").tobytes())
            out.close()

    where = place(folder)
    where[0].create_dir(where[1])
    ordered = texts(docs).withColumn("tie", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    entries = ordered.select("doc_id", "text").mapInArrow(run, "file string, doc_id bigint, row bigint, n_tokens bigint")
    entries.write.parquet(f"{folder}/entries")
    # One row for each shard file; file names ascend with the range that a shard holds.
    sizes = spark.read.parquet(f"{folder}/entries").groupBy("file").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("ids"))
    total = lambda c: F.expr(f"sum({c}) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    sizes.select("file", "docs", "ids", *[F.coalesce(total(c), F.lit(0)).cast("long").alias(f"{c}_before") for c in ("docs", "ids")]).coalesce(1).write.parquet(f"{folder}/shards")


def part_of(n: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("part")


def write_parts(spark: SparkSession, folder: str) -> None:
    """The index: keys are dealt to parts by hash and each part is built by itself."""
    shards = spark.read.parquet(f"{folder}/shards")
    keys = (
        spark.read.parquet(f"{folder}/entries").join(shards.select("file", "docs_before"), "file")
        .groupBy("doc_id").agg(F.min(F.col("docs_before") + F.col("row")).alias("first"), F.count("*").alias("count")))
    n = max(1, -(-(shards.agg(F.sum("docs")).first()[0] or 0) // KEYS_PER_PART))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = place(folder)
        for part, rows in runs(batches, "part"):
            null = pa.compute.is_null(rows["doc_id"]).to_numpy(zero_copy_only=False)
            first, count = rows["first"].to_numpy(), rows["count"].to_numpy()
            k = rows["doc_id"].combine_chunks().fill_null(0).to_numpy().view(np.uint64)[~null]
            at = np.flatnonzero(null)
            name = own_name("part", "mph")
            with where[0].open_output_stream(f"{where[1]}/{name}") as out:
                out.write(part_bytes(k, first[~null], count[~null], (int(first[at[0]]), int(count[at[0]])) if len(at) else (0, 0)))
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "parts": pa.array([n], pa.int64())})

    dealt = keys.select(part_of(n), "doc_id", "first", "count").repartition("part").sortWithinPartitions("part")
    dealt.mapInArrow(build, "part int, file string, parts bigint").write.parquet(f"{folder}/parts")


def runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each value of a sorted column; a value may span batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        v = b.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if held and held[-1].column(column)[0].as_py() != v[i]:
                yield held[0].column(column)[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield held[0].column(column)[0].as_py(), pa.Table.from_batches(held)


def build(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = None, shards: int | None = None) -> None:
    """Write everything. ``tokenizer``: a file of the tokenizers library, at the same
    path on every executor; shards: how many, the session's shuffle partitions if None."""
    spark = docs.sparkSession
    write_shards(docs, tokenizer, folder, end_id, shards or int(spark.conf.get("spark.sql.shuffle.partitions")))
    write_parts(spark, folder)


# -- reading ------------------------------------------------------------------------------------------------------------

def lookup(keys: DataFrame, folder: str) -> DataFrame:
    """For each row of ``keys`` (doc_id) and each document of that key: doc_id, shard,
    row, ids_before. Unknown keys give no row."""
    spark = keys.sparkSession
    parts = {r.part: r.file for r in spark.read.parquet(f"{folder}/parts").collect()}  # one row per KEYS_PER_PART keys
    shards = spark.read.parquet(f"{folder}/shards").orderBy("file").collect()  # one row for each shard file
    n = next(iter(spark.read.parquet(f"{folder}/parts").select("parts").take(1)), [1])[0]
    starts = np.array([s.docs_before for s in shards], np.int64)
    files, before = pa.array([s.file for s in shards], pa.string()), np.array([s.ids_before for s in shards], np.int64)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, held, index = place(folder), None, None
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(v[1:] != v[:-1]) + 1).tolist(), len(v)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if int(v[i]) not in parts:
                    continue
                if held != v[i]:
                    with where[0].open_input_stream(f"{where[1]}/{parts[int(v[i])]}") as f:
                        held, index = v[i], Part(f.read())
                ids = b.column("doc_id").slice(i, j - i)
                first, count = index.find(ids)
                ends = np.cumsum(count)
                for lo in range(0, int(ends[-1]) if len(ends) else 0, ROWS):
                    at = np.arange(lo, min(lo + ROWS, int(ends[-1])))
                    k = np.searchsorted(ends, at, "right")
                    ordinal = first[k] + at - (ends[k] - count[k])
                    s = np.searchsorted(starts, ordinal, "right") - 1
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": ids.take(pa.array(k)), "shard": files.take(pa.array(s)), "row": ordinal - starts[s], "ids_before": before[s]})

    # A key goes to any task of its part's files, not to one task for each part.
    dealt = keys.select(F.col("doc_id").cast("long").alias("doc_id")).select(part_of(n), "doc_id").repartition("part", F.xxhash64("doc_id") % 16)
    return dealt.sortWithinPartitions("part").mapInArrow(find, "doc_id bigint, shard string, row bigint, ids_before bigint")


def read(refs: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian unsigned
    32-bit integers), from what ``lookup`` found."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, held, file, at, width = place(folder), None, None, None, 0
        for b in batches:
            starts, out = [], []
            for shard, row, before in zip(b.column("shard").to_pylist(), b.column("row").to_pylist(), b.column("ids_before").to_pylist(), strict=True):
                if shard != held:
                    if file is not None:
                        file.close()
                    file, held = where[0].open_input_file(f"{where[1]}/{shard}"), shard
                    width, n, magic = np.frombuffer(file.read_at(24, file.size() - 24), "<i8").tolist()
                    if magic != MAGIC:
                        raise ValueError(f"{shard} is not a shard")
                    at = np.frombuffer(file.read_at(8 * (n + 1), file.size() - 24 - 8 * (n + 1)), "<i8")
                i, j = int(at[row]), int(at[row + 1])
                starts.append(before + i)
                out.append(np.frombuffer(file.read_at((j - i) * width, i * width), f"<u{width}").astype("<u4").tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "start": pa.array(starts, pa.int64()), "ids": pa.array(out, pa.binary())})
        if file is not None:
            file.close()

    # Rows of a large shard may be read by several tasks: documents lie in runs of 4096.
    near = refs.repartition("shard", F.floor(F.col("row") / 4096)).sortWithinPartitions("shard", "row")
    return near.mapInArrow(load, "doc_id bigint, start bigint, ids binary")
