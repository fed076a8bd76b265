"""Alignment of sections with criteria, and vector similarity."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions import lexicons as L, text as T
from plumbline.operators.calibration import cosine


def criteria_list(criteria) -> list[tuple]:
    """[(criterion_id, title, description)] from such a list or from the dimension
    table of a framework."""
    if not isinstance(criteria, DataFrame):
        return [tuple(c[:3]) for c in criteria]
    return [tuple(r) for r in criteria.select("criterion_id", "title", "description").orderBy("criterion_id").collect()]


def _words(title: str, description: str | None) -> list[str]:
    found = re.split(r"[\W_]+", f"{title} {description or ''}".lower())
    return sorted({w for w in found if len(w.encode()) > 2 and w not in L.STOP_ALIGN})


def _parts(word: str) -> list[str]:
    """All substrings of more than two bytes: what a section word must be to lie in it."""
    n = len(word)
    return sorted({word[i:j] for i in range(n) for j in range(i + 1, n + 1) if len(word[i:j].encode()) > 2})


def keyword_confidence(section_words: Column, criterion_words: list[str]) -> Column:
    """Share of criterion words that equal, contain or lie in some section word.

    "lies in" is one substring search over the joined words, "contains" one lookup
    among the few section words that are substrings of any criterion word."""
    if not criterion_words:
        return F.lit(0.0)
    joined = F.array_join(section_words, " ")
    inside = F.array_intersect(section_words, T.lit_array(sorted({p for w in criterion_words for p in _parts(w)})))

    def share(x):
        hits = sum(((F.contains(x["j"], F.lit(w)) | F.arrays_overlap(x["i"], T.lit_array(_parts(w)))).cast("int") for w in criterion_words), F.lit(0))
        return F.when(F.size(section_words) == 0, 0.0).otherwise(hits / len(criterion_words))

    return T.let(F.struct(joined.alias("j"), inside.alias("i")), share)


def confidences(docs: DataFrame, criteria) -> DataFrame:
    """(doc_id, section_no, criterion_id, confidence) of every section and criterion.

    Criteria are literals and sections an array of the document row: no join. A
    document of at most two sections covers every criterion with at least 0.15."""
    crits = criteria_list(criteria)
    words = lambda s: T.keywords_set(F.concat(s["title"], F.lit(" "), s["text"]), L.STOP_ALIGN)

    def section(s):
        return T.let(words(s), lambda w: F.array(*[F.struct(
            s["section_no"].alias("section_no"), F.lit(cid).alias("criterion_id"),
            keyword_confidence(w, _words(title, desc)).alias("confidence")) for cid, title, desc in crits]))

    rows = docs.select("doc_id", F.size("sections").alias("n"), F.inline(F.flatten(F.transform("sections", section))))
    c = F.col("confidence")
    return rows.select("doc_id", "section_no", "criterion_id", F.when((F.col("n") <= 2) & (c < 0.1), 0.15).otherwise(c).alias("confidence"))


def align_sections(conf: DataFrame) -> DataFrame:
    return conf.where("confidence > 0.1")


def alignment_gaps(conf: DataFrame, below: float = 0.1) -> DataFrame:
    """Criteria whose best confidence is under the limit, with the best partial
    match (first section on ties; none when nothing matched at all)."""
    best = conf.groupBy("doc_id", "criterion_id").agg(F.min(F.struct((-F.col("confidence")).alias("k"), "section_no")).alias("b"))
    return best.where(-F.col("b.k") < below).select(
        "doc_id", "criterion_id", F.when(-F.col("b.k") > 0, F.col("b.section_no")).alias("best_section"), (-F.col("b.k")).alias("best_confidence"))


def sections_for_criterion(alignments: DataFrame, sections: DataFrame) -> DataFrame:
    return alignments.join(sections, ["doc_id", "section_no"]).orderBy("doc_id", "criterion_id", F.desc("confidence"), "section_no")


def align_contains(docs: DataFrame, criteria, limit: float = 0.3) -> DataFrame:
    """Best section per criterion by the share of title words (over 3 bytes) found in
    its lower-cased text; aligned from ``limit`` on, else a gap."""
    def share(low, title):
        terms = [w for w in title.lower().split() if len(w.encode()) > 3]
        hits = sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))
        return hits / len(terms) if terms else F.lit(0.0)

    lows = F.transform("sections", lambda s: F.struct(
        s["section_no"].alias("no"), F.lower(F.concat(s["title"], F.lit(" "), s["text"])).alias("low")))
    d = docs.select("doc_id", lows.alias("lows"))
    best = lambda title: F.array_min(F.transform("lows", lambda s: F.struct((-share(s["low"], title)).alias("k"), s["no"].alias("no"))))
    rows = F.array(*[F.struct(F.lit(cid).alias("criterion_id"), best(title).alias("b")) for cid, title, _ in criteria_list(criteria)])
    x = d.select("doc_id", F.inline(rows))
    c = -F.col("b.k")
    return x.select("doc_id", "criterion_id", F.when(c > 0, F.col("b.no")).alias("section_no"), c.alias("confidence"), (c >= limit).alias("aligned"))


DEFAULT_SIGNALS = {"label": 0.4, "keywords": 0.4, "parent": 0.2}


def align_weighted(docs: DataFrame, criteria, weights: dict | None = None, limit: float = 0.1) -> DataFrame:
    """Weighted sum of label similarity (title word Jaccard), keyword overlap and
    shared parent (the section is top level, like its criterion); weights are a
    parameter because only thresholds and output fields are fixed."""
    w = {**DEFAULT_SIGNALS, **(weights or {})}
    crits = criteria_list(criteria)
    words = lambda s: T.keywords_set(F.concat(s["title"], F.lit(" "), s["text"]), L.STOP_ALIGN)

    def section(s):
        label = T.keywords_set(s["title"], L.STOP_ALIGN)
        return T.let(F.struct(words(s).alias("w"), label.alias("l")), lambda x: F.array(*[F.struct(
            s["section_no"].alias("section_no"), F.lit(cid).alias("criterion_id"),
            T.jaccard(x["l"], T.lit_array(_words(title, None) or [""])).alias("label"),
            keyword_confidence(x["w"], _words(title, desc)).alias("keywords"),
            (s["level"] == 0).cast("double").alias("parent")) for cid, title, desc in crits]))

    rows = docs.select("doc_id", F.inline(F.flatten(F.transform("sections", section))))
    total = sum((F.col(k) * w[k] for k in DEFAULT_SIGNALS), F.lit(0.0))
    return rows.withColumn("confidence", total).where(F.col("confidence") > limit)


def semantic_topk(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k vectors most similar to one query vector; ties by id. Each task keeps
    its own k best rows."""
    q = F.array(*[F.lit(float(v)) for v in query])
    return vectors.select("vec_id", cosine(F.col("embedding"), q).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(k)


def pair_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine of two ids per row, 0 when either is unknown."""
    v = vectors.select("vec_id", "embedding")
    a = v.withColumnRenamed("vec_id", "id_a").withColumnRenamed("embedding", "va")
    b = v.withColumnRenamed("vec_id", "id_b").withColumnRenamed("embedding", "vb")
    j = pairs.join(a, "id_a", "left").join(b, "id_b", "left")
    return j.select(*pairs.columns, F.coalesce(cosine(F.col("va"), F.col("vb")), F.lit(0.0)).alias("similarity"))


def scoring_tasks(docs: DataFrame, criteria, agents: list[tuple], max_scores: dict[str, float], prompt: bool = True) -> DataFrame:
    """One row per (document, agent, criterion) with the aligned sections, best
    first, inlined into a task text. agents = [(agent_id, name, role)]."""
    titles = {cid: (title, desc) for cid, title, desc in criteria_list(criteria)}
    conf = align_sections(confidences(docs, criteria))
    texts = docs.select("doc_id", F.inline("sections")).select("doc_id", "section_no", "title", "text")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("k"), "section_no", "title", "text")))
    per = conf.join(texts, ["doc_id", "section_no"]).groupBy("doc_id", "criterion_id").agg(ordered.alias("s"))
    body = F.array_join(F.transform("s", lambda x: F.concat(F.lit("## "), x["title"], F.lit("\n"), x["text"])), "\n\n")
    crit = F.array(*[F.struct(F.lit(c).alias("criterion_id"), F.lit(t).alias("criterion_title"), F.lit(d or "").alias("description"),
                              F.lit(float(max_scores[c])).alias("max_score")) for c, (t, d) in titles.items()])
    tasks = docs.select("doc_id", F.inline(crit)).join(per.select("doc_id", "criterion_id", F.size("s").alias("section_count"), body.alias("body")),
                                                     ["doc_id", "criterion_id"], "left")
    who = F.array(*[F.struct(F.lit(i).alias("agent_id"), F.lit(n).alias("name"), F.lit(r).alias("role")) for i, n, r in agents])
    tasks = tasks.select("*", F.inline(who)).withColumn("section_count", F.coalesce("section_count", F.lit(0)))
    if not prompt:
        return tasks.drop("body")
    text = F.format_string("%s (%s)\nCriterion: %s\n%s\nMaximum: %.1f\n\n%s", "name", "role", "criterion_title", "description", "max_score",
                           F.coalesce("body", F.lit("")))
    return tasks.withColumn("prompt", text).drop("body")
