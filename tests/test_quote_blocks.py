"""Quotes of one document in many blocks; covered characters over pieces."""

import random

from plumbline.operators import graph

NODE = "doc_id long, node_id string, node_type string, source_text string, span struct<start: int, end: int>"


def test_many_quotes_of_long_texts(spark):
    rng = random.Random(1)
    texts = {d: " ".join(rng.choice(["alpha", "Beta", "gamma", "é😀", "delta,", "\n"]) for _ in range(3000 if d else 40)) for d in range(3)}
    rows = []
    for i in range(1200):
        d = 0 if i % 20 == 0 else 1
        a = rng.randrange(len(texts[d]))
        q = texts[d][a:a + rng.choice([1, 30, 400, 9000])]
        kind = rng.randrange(4)
        q = None if kind == 0 else "nowhere to be found" if kind == 1 else q
        rows.append((d, f"n{i}", "Evidence", q, (a, a + len(q)) if q and kind == 3 else None))
    rows.append((2, "s", "Structural", None, None))
    nodes, docs = spark.createDataFrame(rows, NODE), spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in graph.verify_spans(nodes, docs).collect()}
    for d, text in texts.items():
        mine = [r for r in rows if r[0] == d]
        seen, ok = set(), 0
        for _, _, _, q, span in mine:
            if q is not None and q in text:
                ok += 1
                a = span[0] if span and text[span[0]:span[1]] == q else text.index(q)
                seen |= set(range(a, a + len(q)))
        with_source = sum(r[3] is not None for r in mine)
        assert (got[d].total_nodes, got[d].nodes_with_source, got[d].verified_count, got[d].failed_count) == (len(mine), with_source, ok, with_source - ok)
        assert abs(got[d].coverage - len(seen) / len(text)) < 1e-12
    checks = {r.doc_id: (r.verified, r.unverified) for r in graph.quote_check(nodes, docs).collect()}
    squash = lambda x: " ".join(x.lower().split())
    for d in (0, 1):
        quotes = [r[3] or "" for r in rows if r[0] == d]
        found = sum(q != "" and (q in texts[d] or squash(q) in squash(texts[d])) for q in quotes)
        assert checks[d] == (found, len(quotes) - found)
