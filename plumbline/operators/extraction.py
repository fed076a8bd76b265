"""Rule extraction of citations, statistics, claims, predictions and commitments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import lexicons as L, text as T

MIN_SENTENCE = 15
BRACKETS = r"\([^)]*\)"


def _item(kind: str, text: Column, start: Column, end: Column, order: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("item_type"), text.alias("text"), start.alias("start"), end.alias("end"),
        F.lit("rule").alias("method"), F.lit(L.CONFIDENCE[kind]).alias("confidence"),
        order.alias("ord"), T.words(text).alias("tokens"))


def citation_items(c: Column) -> Column:
    """Every "( ... )" group with a year and under 60 inner bytes, with its span.

    A group starts after all gaps up to it and all groups before it."""
    def locate(groups):
        gaps = F.split(c, BRACKETS)
        return F.transform(groups, lambda g, i: F.struct(
            g.alias("text"),
            (F.length(F.array_join(F.slice(gaps, 1, i + 1), "")) + F.length(F.array_join(F.slice(groups, 1, i), ""))).alias("start")))

    inner = lambda s: F.substr(s, F.lit(2), F.length(s) - 2)
    cites = lambda s: T.has_year(inner(s)) & (F.octet_length(inner(s)) < 60)
    groups = F.regexp_extract_all(c, F.lit(BRACKETS), F.lit(0))
    located = T.let(groups, lambda g: F.when(F.exists(g, cites), locate(g)).otherwise(T.empty_like(locate(g))))
    kept = F.filter(located, lambda s: cites(s["text"]))
    return F.transform(kept, lambda s, i: _item(
        "citation", s["text"], s["start"], s["start"] + F.length(s["text"]), i))


def _sentence_structs(c: Column) -> Column:
    return F.transform(T.sentences_dot(c, MIN_SENTENCE), lambda s: F.struct(s.alias("t"), F.lower(s).alias("l")))


def is_statistic(s: Column, low: Column) -> Column:
    return F.rlike(s, F.lit("[0-9]")) & (T.contains_any(s, L.STATISTIC_UNITS) | T.contains_any(low, L.STATISTIC_WORDS))


SENTENCE_RULES = {  # in output order
    "statistic": is_statistic,
    "claim": lambda s, low: T.contains_any(low, L.CLAIM_MARKERS),
    "prediction": lambda s, low: T.contains_any(low, L.PREDICTION_MARKERS),
    "commitment": lambda s, low: T.contains_any(low, L.COMMITMENT_MARKERS),
}


def sentence_items(c: Column, kind: str, sents: Column | None = None) -> Column:
    rule = SENTENCE_RULES[kind]
    hits = F.filter(_sentence_structs(c) if sents is None else sents, lambda s: rule(s["t"], s["l"]))

    def out(s, i):
        at = F.position(s["t"], c) - 1
        return _item(kind, s["t"], at, at + F.length(s["t"]), i)

    return F.transform(hits, out)


def all_items(c: Column) -> Column:
    """Items of all five rules, rule by rule, each in text order (duplicates kept). The text
    is cut into sentences once."""
    found = T.let(_sentence_structs(c), lambda s: F.concat(citation_items(c), *[sentence_items(c, k, s) for k in SENTENCE_RULES]))
    return F.transform(found, lambda x, i: x.withField("ord", i))


def dedup_items(items: Column, order: str = "confidence") -> Column:
    """Greedy near-duplicate removal by falling confidence (ties in rule order):
    an item goes when its word Jaccard with a kept one exceeds 0.7.

    ``order="position"`` re-sorts the survivors by text position."""
    ranked = F.array_sort(F.transform(items, lambda x: F.struct((-x["confidence"]).alias("k"), x["ord"].alias("o"), x.alias("x"))))
    kept = T.greedy_keep(
        F.transform(ranked, lambda r: r["x"]), lambda k, x: T.jaccard(k["tokens"], x["tokens"]) > 0.7)
    if order == "position":
        kept = F.transform(
            F.array_sort(F.transform(kept, lambda x: F.struct(x["start"].alias("k"), x["ord"].alias("o"), x.alias("x")))),
            lambda r: r["x"])
    return F.transform(kept, lambda x: F.struct(
        x["item_type"].alias("item_type"), x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"),
        x["method"].alias("method"), x["confidence"].alias("confidence")))


def extract(c: Column, order: str = "confidence") -> Column:
    return dedup_items(all_items(c), order)


def with_items(docs: DataFrame, order: str = "confidence") -> DataFrame:
    """Adds ``items`` (array) to every element of ``sections``."""
    return docs.withColumn(
        "sections", F.transform("sections", lambda s: s.withField("items", extract(s["text"], order))))


def item_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, section_no, item_no, item_type, text, start, end, method, confidence)"""
    return (
        docs.select("doc_id", F.explode("sections").alias("s"))
        .select("doc_id", F.col("s.section_no").alias("section_no"), F.posexplode("s.items").alias("item_no", "i"))
        .select("doc_id", "section_no", "item_no", "i.*"))


def merge_items(rule_items: Column, other_items: Column) -> Column:
    """Fold a second source into the rule items: the first item with Jaccard over
    0.6 becomes hybrid with confidence min(a + b, 1) * 0.9; others are appended."""
    toks = lambda x: T.words(x["text"])

    def fold(acc, o):
        at = F.array_position(F.transform(acc, lambda k: T.jaccard(toks(k), toks(o)) > 0.6), F.lit(True))
        boosted = F.transform(acc, lambda k, i: F.when(
            i + 1 == at, k.withField("method", F.lit("hybrid")).withField(
                "confidence", F.least(k["confidence"] + o["confidence"], F.lit(1.0)) * 0.9)).otherwise(k))
        return F.when(at > 0, boosted).otherwise(F.concat(acc, F.array(o)))

    return F.aggregate(other_items, rule_items, fold)


def claims_and_evidence(items: DataFrame, *more: str) -> DataFrame:
    """Maps item rows to claim rows (specificity, verifiable) and evidence rows; ``more``: columns kept."""
    kind = F.col("item_type")
    is_claim = kind.isin("claim", "argument", "prediction", "commitment")
    return items.select(
        "doc_id", "section_no", "item_no", F.when(is_claim, "claim").otherwise("evidence").alias("role"), "text",
        F.when(is_claim, F.col("confidence")).alias("specificity"),
        F.when(is_claim, kind.isin("prediction", "commitment")).alias("verifiable"),
        F.when(~is_claim, F.concat("method", F.lit("-extracted"))).alias("source"),
        F.when(~is_claim, kind).alias("evidence_type"),
        F.when(~is_claim, kind == "statistic").alias("quantified"), *more)


def fallback_items(c: Column) -> Column:
    """Second-chance extraction: array<struct<role, text, specificity, verifiable, source, evidence_type, quantified>>."""
    def rows(s):
        t, low = s["t"], s["l"]
        claim = T.contains_any(low, L.FALLBACK_CLAIMS)
        brackets = F.contains(t, F.lit("(")) & F.contains(t, F.lit(")"))
        evidence = (brackets & T.contains_any(low, L.FALLBACK_PAREN_EVIDENCE)) | T.contains_any(low, L.FALLBACK_EVIDENCE)
        quantified = T.contains_any(low, L.FALLBACK_QUANTIFIED)
        spec = F.when(T.contains_any(t, ["%", "£"]), 0.9).when(F.octet_length(t) > 80, 0.7).otherwise(0.5)
        group = r"^[^(]*\(([^)]*)\)"
        source = F.when(F.rlike(t, F.lit(group)), F.regexp_extract(t, group, 1)).otherwise("inline data")
        none_s, none_b = F.lit(None).cast("string"), F.lit(None).cast("boolean")
        as_claim = F.struct(
            F.lit("claim").alias("role"), t.alias("text"), spec.alias("specificity"), evidence.alias("verifiable"),
            none_s.alias("source"), none_s.alias("evidence_type"), none_b.alias("quantified"))
        as_evidence = F.struct(
            F.lit("evidence").alias("role"), t.alias("text"), F.lit(None).cast("double").alias("specificity"),
            none_b.alias("verifiable"), source.alias("source"),
            F.when(quantified, "statistical").otherwise("citation").alias("evidence_type"), quantified.alias("quantified"))
        return F.array_compact(F.array(F.when(claim, as_claim), F.when(evidence, as_evidence)))

    return F.flatten(F.transform(_sentence_structs(c), rows))
