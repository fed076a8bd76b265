import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import token_index
from plumbline.llm.common import work_folder
from plumbline.llm.queries import QUERIES
from tests.llm import cases

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def test_perfect_hash():
    for n in (0, 1, 2, 63, 5000):
        keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
        h = token_index.PerfectHash.build(keys)
        assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
        part = token_index.Part(token_index.part_bytes(keys, np.arange(len(keys)), np.ones(len(keys), np.int64), (0, 0)))
        import pyarrow as pa
        first, count = part.find(pa.array(keys.view(np.int64)))
        assert first.tolist() == list(range(len(keys))) and (count == 1).all()
        strange = np.random.default_rng(9).integers(2**62, 2**63, 1000)
        assert part.find(pa.array(np.setdiff1d(strange, keys.view(np.int64))))[1].sum() == 0


def test_word_table_is_the_library():
    t, table, rng = Tokenizer.from_file(PATH), token_index.WordTable(PATH), random.Random(3)
    assert table.by_word and table.no_case and table.plain
    alphabet = ["a", "The", " ", "\n", "\t", "é", "É", "ﬁ", "漢", "😀", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'T", ".", ",", '",', "Σ", "İ", "́", " ", "\x85", "\x1c", "3", "½", "_", "ß", "ſ", "µ"]
    latin = [c for c in alphabet if max(c) <= "\xff"] + ["H\u0331", "It's,", "ab.", "X.Y,Z", "é,", "ÿ"]
    texts = ["".join(rng.choices(a, k=rng.randrange(1, 40))) for a in (alphabet, latin) for _ in range(4000)] + [x or "" for x in cases.ODD]
    for x in texts:
        assert np.frombuffer(table.encode(x), "<u2").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_op1_against_the_library(spark):
    t = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in QUERIES["op1_token_index"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    start = 0
    for d in docs:
        ids = [*t.encode(d.text or "", add_special_tokens=False).ids, 2]
        assert tuple(got.pop(d.doc_id)) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got


def test_odd_documents(spark):
    d, folder = cases.odd(spark), work_folder(spark, "odd")
    token_index.build(d, PATH, folder, end_id=2, shards=3)
    keys = d.select("doc_id").distinct()
    rows = token_index.read(token_index.lookup(keys, folder), folder).orderBy("start").collect()
    assert len(rows) == d.count() and [r.start for r in rows] == np.cumsum([0, *[len(r.ids) // 4 for r in rows]])[:-1].tolist()
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in d.select("doc_id").collect()), key=lambda k: (k is not None, k))
    assert token_index.lookup(spark.range(10_000, 10_500).select(F.col("id").alias("doc_id")), folder).count() == 0
    none = work_folder(spark, "none")
    token_index.build(cases.empty(spark), PATH, none)
    assert token_index.read(token_index.lookup(keys, none), none).count() == 0
