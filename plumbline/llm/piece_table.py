"""SentencePiece encoding with a table of distinct chunks.

Where no piece of a vocabulary has a white-space marker behind another character,
pieces never cross into the next marked word, and merges inside one marked word do not
depend on its neighbours. A chunk (markers, then the characters up to the next marker,
line end or a mark that no piece has behind a letter) is therefore segmented once; a document's ids are the chunks' ids joined
by position. Chunks that a task has segmented stay in a table of bounded size.

A vocabulary or normalizer for which this does not hold is found out when the model is
loaded, and whole texts go to the library then.

Defined results: a null text is empty and has no ids; one row out for each row in.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import sentencepiece
from pyspark.sql import Column, functions as F, types as T

MARK = "▁"
#: Chunks that a Python worker holds, the longest that it holds on to, and characters that it encodes at once.
TABLE_SIZE, TABLE_CHARS, GROUP = 400_000, 48, 1 << 20
IDS = T.ArrayType(T.IntegerType())
#: Where no piece has a letter before a closing mark, words are found again without the mark behind them.
LETTERS = [c for c in map(chr, range(256)) if c.isalpha()]
ENDS = ',.;:!?|"'
CHUNK = re.compile(f"{MARK}*+[{''.join(LETTERS)}]++(?=[{ENDS}])|{MARK}*[^{MARK}\n]+|{MARK}+|\n")
#: A text that the table's rules must leave alone if it is to be used.
PROBE = f"a  b ﬁ ½　Á\t{MARK}c  "


class ChunkTable:
    def __init__(self, model_file: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        own = [i for i in range(self.sp.get_piece_size()) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i))]
        pieces = [self.sp.id_to_piece(i) for i in own]
        pairs = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
        self.lead = self.sp.encode("\n")
        self.exact = (
            not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces)
            and self.sp.normalize(PROBE) == MARK + PROBE.replace(" ", MARK)
            and self.sp.encode("\n\n") == self.lead + self.lead[-1:] and len(self.lead) == 2)
        ends = {a for a in LETTERS if any(a + b in pairs for b in ENDS)}
        self.chunk = CHUNK if not ends else re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        self.table: dict[str, bytes] = {}

    def segment(self, chunks: list[str]) -> list[bytes]:
        """Ids as 32-bit integers. A line end goes first, so that the marker which
        the library puts before a text is not part of the chunk."""
        return [array("i", x[2:]).tobytes() for x in self.sp.encode(["\n" + c for c in chunks], num_threads=1)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.exact:
            return [array("i", x).tobytes() for x in self.sp.encode(texts, num_threads=1)]
        out, group, size = [], [], 0
        for text in texts:
            group.append(self.chunk.findall(MARK + text.replace(" ", MARK)) if text else [])
            size += len(text)
            if size > GROUP:
                out += self.joined(group)
                group, size = [], 0
        return out + self.joined(group)

    def joined(self, docs: list[list[str]]) -> list[bytes]:
        """The ids of documents given as chunks: new chunks are segmented, all are joined by position."""
        table = self.table
        new = list(set().union(*docs).difference(table))
        if len(table) + len(new) > TABLE_SIZE:
            table.clear()
            new = list(set().union(*docs))
        table.update(zip(new, self.segment(new), strict=True))
        out = [b"".join(map(table.__getitem__, chunks)) for chunks in docs]
        for c in new:
            if len(c) > TABLE_CHARS:
                del table[c]
        return out

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """One list of Python integers at a time: a batch of them would be ten times its ids."""
        values, at = ids.values.to_numpy(), ids.offsets.to_numpy()
        return pa.array((self.sp.decode(values[i:j].tolist()) for i, j in zip(at, at[1:], strict=False)), pa.string(), size=len(ids))


@lru_cache(maxsize=2)
def chunk_table(model_file: str) -> ChunkTable:
    return ChunkTable(model_file)


def encoder(model_file: str):
    """Column function: text -> ids. The file's path must exist on every executor."""

    @F.arrow_udf(IDS)
    def encode(text: pa.Array) -> pa.Array:
        return as_lists(chunk_table(model_file).encode([x or "" for x in text.to_pylist()]))

    return lambda text: encode(F.col(text) if isinstance(text, str) else text)


def decoder(model_file: str):
    """Column function: ids -> text (null ids: empty)."""

    @F.arrow_udf(T.StringType())
    def decode(ids: pa.Array) -> pa.Array:
        return chunk_table(model_file).decode(pa.compute.if_else(ids.is_null(), pa.scalar([], ids.type), ids)) if len(ids) else pa.array([], pa.string())

    return lambda ids: decode(F.col(ids) if isinstance(ids, str) else ids)


def round_trip(model_file: str):
    """Column function: text -> struct of ids and what they decode to, in one pass."""

    @F.arrow_udf(T.StructType().add("ids", IDS).add("decoded", T.StringType()))
    def both(text: pa.Array) -> pa.Array:
        table = chunk_table(model_file)
        ids = as_lists(table.encode([x or "" for x in text.to_pylist()]))
        return pa.StructArray.from_arrays([ids, table.decode(ids)], names=["ids", "decoded"])

    return lambda text: both(F.col(text) if isinstance(text, str) else text)


def as_lists(parts: list[bytes]) -> pa.Array:
    sizes = np.fromiter((len(x) // 4 for x in parts), np.int64, len(parts))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def decoder(model_file: str):
    """Column function: ids -> text."""

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        # One list of Python integers at a time: a batch of them would be ten times its ids.
        sp = chunk_table(model_file).sp
        return pa.array((sp.decode(x.as_py() or []) for x in ids), pa.string(), size=len(ids))

    return lambda ids: decode(F.col(ids) if isinstance(ids, str) else ids)


def ids_digest(ids: Column) -> Column:
    """sha256 of the decimal ids joined by commas."""
    return F.sha2(F.concat_ws(",", ids.cast("array<string>")), 256)
