"""Language identification: learning and scoring against a plain version, accuracy on held-out rows."""

import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from plumbline.llm import language_id
from plumbline.llm.queries import QUERIES
from tests.llm import cases

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def cut(word, o):
    if o == 1:
        return list(word)
    return [f"^{word}$"[i:i + o] for i in range(len(word) + 3 - o)]


def plain(rows):
    """Judges texts with tables counted from (lang, text) rows, one number at a time."""
    counts, pieces = {}, {o: {} for o in range(1, 6)}
    for lang, text in rows:
        for w in WORD.findall(text.lower()):
            counts.setdefault(lang, Counter())[w] += 1
            for o in pieces:
                for g in cut(w, o):
                    pieces[o].setdefault(lang, Counter())[g] += 1
    langs = sorted(counts)

    def table(by_lang, share):
        totals = {k: by_lang[k].total() for k in langs}
        items = {x for c in by_lang.values() for x in c}
        kept = {x for x in items if sum(by_lang[k][x] for k in langs) >= 2 and sum(by_lang[k][x] / totals[k] for k in langs) / len(langs) >= share}
        return {x: [math.log((by_lang[k][x] + 0.1) / (totals[k] + 0.1 * (len(kept) + 1))) for k in langs] for x in kept}

    known, by_order = table(counts, 2e-6), {o: table(c, 1e-5) for o, c in pieces.items()}

    def judge(text):
        total, hits, n = [0.0] * len(langs), 0, 0
        for w in WORD.findall((text or "").lower()):
            n += 1
            rows = [known[w]] if w in known else []
            hits += bool(rows)
            for o in range(5, 0, -1):
                if not rows:
                    rows = [by_order[o][g] for g in cut(w, o) if g in by_order[o]]
            for r in rows:
                total = [a + b / len(rows) for a, b in zip(total, r)]
        if not n:
            return "und", 0.0, 0, 0
        best = max(range(len(langs)), key=lambda i: total[i])
        return langs[best], 1 / sum(math.exp(t - total[best]) for t in total), n, hits

    return judge


def test_query_is_the_plain_version_and_right_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    judge = plain([(d.lang, d.text) for d in docs if d.lang is not None and d.text and not held_out(d.doc_id)])
    got = {r.doc_id: r for r in QUERIES["op11_language_id"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        lang, score, n, hits = judge(d.text)
        r = got[d.doc_id]
        assert (r.held_out, r.lang_pred, r.n_words, r.n_known) == (held_out(d.doc_id), lang, n, hits) and abs(r.score - score) < 1e-6
    test = [d for d in docs if held_out(d.doc_id)]
    assert sum(got[d.doc_id].lang_pred == d.lang for d in test) >= 0.98 * len(test)


def test_unseen_words_back_off(spark):
    rows = [("en", "the thing with the weather is that this thinks"), ("de", "schön ist die schule und schnell schreiben wir schluss")] * 3
    model = language_id.fit(spark.createDataFrame(rows, "lang string, text string"))
    lang, score, n, known = model.judge(["schraube schrank", "thither thinner", "the schule", "漢字", "12", None])
    # nothing known: the language with most words
    assert lang == ["de", "en", lang[2], "en" if model.totals[1] > model.totals[0] else "de", "und", "und"] and list(n) == [2, 2, 2, 1, 0, 0]
    assert list(known) == [0, 0, 2, 0, 0, 0] and list(score[3:]) == [0.5, 0, 0]


def test_odd_rows(spark):
    odd, none = cases.odd(spark), cases.empty(spark)
    model = language_id.fit(odd.withColumn("lang", F.when(F.col("text").isNotNull(), F.coalesce("lang", F.lit("xx")))))
    for m in (model, language_id.fit(none), language_id.fit(odd.where("lang IS NULL"))):
        got = language_id.predict(odd, m).collect()
        assert len(got) == odd.count() and language_id.predict(none, m).count() == 0
        for r in got:
            assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (r.n_words == 0 or not m.langs)
    assert language_id.words("² Ⅳ 3 _ x²y") == ["x", "y"] and not language_id.words("12 _ ² ́")
