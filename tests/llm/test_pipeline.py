"""The pipeline against a brute-force version, stage by stage, each on its own input."""

import public_tokenizers
import sentencepiece

import corpus_pipeline
from plumbline.llm import decontaminate, quality_rules
from plumbline.llm.common import keep
from tests.llm import cases
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_shingle_join import brute as brute_groups, brute_components
from tests.llm.test_text_scans import brute_quality

SF = "/root/testdata/sf0.001"


def good(text):
    n, chars, symbols, lines, twice, repeated = brute_quality(text)
    return not (n < 20 or 100 * repeated > 30 * n or 10 * symbols > 3 * n or (twice >= 5 and 2 * twice > lines) or chars < 2 * n or chars > 20 * n)


def cut_lines(rows):
    all_lines, links = brute_lines(rows)
    component, at = brute_components(links), {x: i for i, x in enumerate(all_lines)}
    seen, out = set(), []
    for k, t in sorted(rows):
        left = []
        for x in t.split("\n"):
            c = component.get(at[x], at[x]) if len(x) >= 20 else None
            if c is None or c not in seen:
                left.append(x)
            if c is not None:
                seen.add(c)
        out.append((k, "\n".join(left)))
    return out


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, items = docs.columns, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    joined = lambda t: b" " + b" ".join(decontaminate.words_of(t)) + b" "
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    brute = [
        lambda rows: [(k, t) for k, t in rows if good(t)], cut_lines,
        lambda rows: [(k, dict(rows)[k]) for k, _, c in brute_groups(rows) if k == c],
        lambda rows: [(k, t) for k, t in rows if not any(joined(i) in joined(t) for i in items)]]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "shingle_join", "decontamination", "sentencepiece"]
    for (name, stage), expected in zip(corpus_pipeline.STAGES, brute, strict=False):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        docs = keep(stage(spark, docs, SF), name)
        assert docs.columns == columns, name
        got = sorted((r.doc_id, r.text) for r in docs.collect())
        want = sorted(expected(rows))
        if name == "decontamination":  # paraphrases may go, too
            assert set(got) <= set(want) and len(got) >= len(want) - 2
        else:
            assert got == want, name
    last = {r.doc_id: (r.ids, r.decoded) for r in corpus_pipeline.run(spark, SF).collect()}
    assert last == {k: (sp.encode(t), sp.decode(sp.encode(t))) for k, t in got}


def test_odd_documents(spark):
    for docs in (cases.odd(spark), cases.empty(spark)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = keep(stage(spark, docs, SF), name)
            assert docs.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_quality_policy_is_the_ledger(spark):
    d = cases.odd(spark)
    assert quality_rules.filter_docs(d).count() == quality_rules.build_ledger(d).where(quality_rules.passes("v1")).count()
