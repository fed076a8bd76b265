"""Quality checks over documents with sections: each yields 0..n signals per document.

A check is an expression over one document row (doc_type, sections), so all of
them run in a single narrow pass; only number consistency needs a join.
signal = struct<check, severity, section_no, title, value, effect>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import lexicons as L, text as T
from plumbline.session import settle

SIGNAL = "struct<check:string,severity:string,section_no:int,title:string,value:double,effect:double>"


def _sig(check: str, severity: str, effect: float, title, value=None, section: Column | None = None) -> Column:
    return F.struct(
        F.lit(check).alias("check"), F.lit(severity).alias("severity"),
        (F.lit(None) if section is None else section).cast("int").alias("section_no"),
        (F.lit(title) if isinstance(title, str) else title).alias("title"),
        (F.lit(None) if value is None else value).cast("double").alias("value"), F.lit(float(effect)).alias("effect"))


def _collect(*signals: Column) -> Column:
    return F.array_compact(F.array(*signals))


def prepare(docs: DataFrame) -> DataFrame:
    """Adds the lower-cased text and citations of every section and the document's words."""
    secs = F.transform("sections", lambda s: F.struct(
        s["section_no"].alias("section_no"), s["title"].alias("title"), F.lower(s["title"]).alias("ltitle"), s["text"].alias("text"),
        F.lower(s["text"]).alias("low"), s["word_count"].alias("words"), T.citations(s["text"]).alias("cites")))
    d = docs.select("doc_id", "doc_type", secs.alias("secs"))
    return d.withColumn("total", F.aggregate("secs", F.lit(0), lambda a, s: a + s["words"]))


def _per_section(fn) -> Column:
    return F.flatten(F.transform("secs", fn))


def citation_recency() -> Column:
    def section(s):
        none = F.when((F.size(s["cites"]) == 0) & (s["words"] > 100), _sig(
            "citation_format", "warning", -0.05, "no citations", s["words"], s["section_no"]))

        def one(c):
            age = F.greatest(F.lit(L.CURRENT_YEAR) - c["year"], F.lit(0))
            who = F.concat(c["author"], F.lit(" ("), c["year"].cast("string"), F.lit(")"))
            return F.when(age > 10, _sig("citation_recency", "warning", -0.05, F.concat(F.lit("outdated source: "), who), age, s["section_no"])).when(
                age <= 3, _sig("citation_recency", "info", 0.1, F.concat(F.lit("recent source: "), who), age, s["section_no"]))

        return F.concat(_collect(none), F.array_compact(F.transform(s["cites"], one)))

    return _per_section(section)


def word_counts() -> Column:
    minimum = T.lookup(F.col("doc_type"), L.WORD_MINIMUM, L.WORD_MINIMUM_OTHER)
    n = F.transform("secs", lambda s: s["words"])
    low, high = F.array_min(n), F.array_max(n)
    return _collect(
        F.when(F.col("total") < minimum, _sig("word_count", "warning", -0.05, "document may be too short", F.col("total"))),
        F.when((F.size("secs") >= 2) & (low > 0) & (high > low * 5), _sig("word_count", "info", -0.05, "unbalanced section lengths", high / F.nullif(low, F.lit(0)))))


def structure() -> Column:
    has = lambda words: F.exists("secs", lambda s: T.contains_any(s["ltitle"], words))
    missing = []
    for types, expected in L.EXPECTED_SECTIONS:
        for k in expected:
            missing.append(F.when(F.col("doc_type").isin(types) & ~has([k]), _sig("structure", "warning", -0.05, f"missing section: {k}")))
    whole = F.when(has(L.INTRO_TITLES) & has(L.CONCLUSION_TITLES), _sig("structure", "info", 0.1, "has introduction and conclusion"))
    return _collect(*missing, whole)


def reading_level() -> Column:
    text = F.array_join(F.transform("secs", lambda s: s["text"]), " ")
    low = T.lookup(F.col("doc_type"), [(k, a) for k, a, _ in L.READING_RANGE], L.READING_RANGE_OTHER[0])
    high = T.lookup(F.col("doc_type"), [(k, b) for k, _, b in L.READING_RANGE], L.READING_RANGE_OTHER[1])

    def grade(fk):
        return _collect(F.when(F.col("total") >= 50, F.when(
            fk < low, _sig("reading_level", "info", -0.05, "reading level may be too simple", fk)).when(
            fk > high, _sig("reading_level", "info", 0.0, "reading level is very high", fk)).otherwise(
            _sig("reading_level", "info", 0.05, "reading level appropriate", fk))))

    return T.let(T.flesch_kincaid(text), grade)


def paragraph_keys(sections: str = "secs", split: str = "\n\n") -> Column:
    """array<struct<section_no, key>> of paragraphs over 80 bytes; the key is the
    first 60 characters of the lower-cased letters, digits and spaces."""
    key = lambda p: F.substring(F.lower(F.regexp_replace(p, rf"[^\p{{L}}\p{{N}}{T.WS_CLASS}]", "")), 1, 60)
    return F.flatten(F.transform(sections, lambda s: F.transform(
        F.filter(F.transform(F.split(s["text"], split), T.ws_trim), lambda p: F.octet_length(p) > 80),
        lambda p: F.struct(s["section_no"].alias("section_no"), key(p).alias("key")))))


def duplicate_paragraphs() -> Column:
    def flag(ps):
        keys = F.transform(ps, lambda p: p["key"])
        return T.let(keys, lambda ks: F.array_compact(F.transform(ps, lambda p: F.when(
            F.element_at(ps, F.array_position(ks, p["key"]).cast("int"))["section_no"] != p["section_no"],
            _sig("duplicate_content", "warning", -0.05, "duplicate paragraph", None, p["section_no"])))))

    return T.let(paragraph_keys(), lambda ps: F.when(F.size(ps) > 0, flag(ps)).otherwise(F.array().cast(f"array<{SIGNAL}>")))


def evidence_quality(claims: str = "claims", evidence: str = "evidence", quantified: str = "quantified") -> Column:
    """Over per-document counts held in three columns."""
    c, e, n = F.col(claims), F.col(evidence), F.col(quantified)
    ratio, share = e / F.nullif(c, F.lit(0)), n / F.nullif(e, F.lit(0)) * 100.0
    return _collect(
        F.when(c > 0, F.when(ratio < 0.5, _sig("evidence_quality", "warning", -0.05, "low evidence-to-claim ratio", ratio)).when(
            ratio >= 1.0, _sig("evidence_quality", "info", 0.1, "strong evidence-to-claim ratio", ratio))),
        F.when((e > 0) & (share >= 50.0), _sig("evidence_quality", "info", 0.1, "evidence is quantified", share)))


def reference_style() -> Column:
    total = lambda fn: F.aggregate(F.transform("secs", fn), F.lit(0), lambda a, x: a + x)
    harvard = total(lambda s: F.size(s["cites"]))
    numeric = total(lambda s: F.size(F.filter(
        F.regexp_extract_all(s["text"], F.lit(r"\[([^\]]*)\]"), F.lit(1)), lambda g: F.rlike(T.ws_trim(g), F.lit(r"^\+?[0-9]{1,9}$")))))
    marks = total(lambda s: F.regexp_count(s["text"], F.lit(f"[{L.FOOTNOTE_MARKS}]")) + F.when(
        F.contains(s["text"], F.lit("^")), F.regexp_count(T.plain_ws(s["text"]), F.lit(r"(?<!\S)\^\+?[0-9]{1,9}(?!\S)"))).otherwise(0))

    def judge(v):
        h, n, f = v["h"], v["n"], v["f"]
        styles = (h > 0).cast("int") + (n > 0).cast("int") + (f > 0).cast("int")
        name = F.when(h > 0, "author-year").when(n > 0, "numeric").otherwise("footnote")
        return _collect(F.when(styles > 1, _sig("reference_style", "warning", -0.05, "mixed citation styles", styles)).when(
            (styles == 1) & (h + n + f >= 3), _sig("reference_style", "info", 0.05, F.concat(F.lit("consistent style: "), name), h + n + f)))

    return T.let(F.struct(harvard.alias("h"), numeric.alias("n"), marks.alias("f")), judge)


def fallacies() -> Column:
    return _per_section(lambda s: _collect(*[
        F.when(F.contains(s["low"], F.lit(m)), _sig("logical_fallacy", "warning", -0.15, f"{name}: {m}", None, s["section_no"]))
        for name, markers in L.FALLACIES for m in markers]))


def hedging() -> Column:
    def section(s):
        rates = F.struct(
            (T.occurrences_total(s["low"], L.HEDGES) / s["words"] * 100.0).alias("hedge"),
            (T.occurrences_total(s["low"], L.STRONG_ASSERTIONS) / s["words"] * 100.0).alias("strong"))
        sig = T.let(rates, lambda r: F.when(r["hedge"] > 8.0, _sig("hedging", "warning", -0.1, "over-hedged section", r["hedge"], s["section_no"])).when(
            (r["hedge"] < 1.0) & (r["strong"] > 3.0), _sig("hedging", "warning", -0.1, "under-hedged section", r["strong"], s["section_no"])).when(
            r["hedge"].between(3.0, 8.0), _sig("hedging", "info", 0.05, "well-balanced hedging", r["hedge"], s["section_no"])))
        return F.when(s["words"] >= 30, _collect(sig)).otherwise(F.array().cast(f"array<{SIGNAL}>"))

    return _per_section(section)


def topic_sentences() -> Column:
    def paragraph(s, p):
        def judge(sents):
            n = F.size(sents)
            first = T.topic_words(F.get(sents, F.lit(0)), 3)
            rest = F.slice(sents, 2, F.greatest(n - 1, F.lit(0)))
            share = T.let(first, lambda f: F.when(F.size(f) > 0, F.size(F.filter(
                rest, lambda x: F.arrays_overlap(f, T.topic_words(x, 3)))) / F.nullif(F.size(rest), F.lit(0))))
            weak = T.let(F.when(n >= 4, share), lambda v: F.when(v < 0.3, _sig(
                "topic_sentence", "info", -0.05, "weak topic sentence", v * 100.0, s["section_no"])))
            return _collect(F.when(n > 10, _sig("topic_sentence", "info", -0.05, "long paragraph", n, s["section_no"])), weak)

        return T.let(T.sentences_ws(p), judge)

    return _per_section(lambda s: F.flatten(F.transform(T.paragraphs(s["text"]), lambda p: paragraph(s, p))))


def counter_arguments() -> Column:
    hits = F.transform(F.filter("secs", lambda s: s["words"] >= 200), lambda s: F.struct(
        s["section_no"].alias("no"), s["words"].alias("words"), T.occurrences_total(s["low"], L.COUNTER_MARKERS).alias("n")))

    def judge(h):
        total = F.aggregate(h, F.lit(0), lambda a, x: a + x["n"])
        none = F.transform(F.filter(h, lambda x: x["n"] == 0), lambda x: _sig(
            "counter_argument", "info", -0.05, "no counter-argument engagement", x["words"], x["no"]))
        doc = F.when(total == 0, _sig("counter_argument", "warning", -0.15, "no counter-arguments in document", F.col("total"))).when(
            total >= 3, _sig("counter_argument", "info", 0.1, "good counter-argument engagement", total))
        return F.concat(none, _collect(doc))

    applies = ~F.col("doc_type").isin("contract", "legal") & (F.col("total") >= 500)
    return F.when(applies, T.let(hits, judge)).otherwise(F.array().cast(f"array<{SIGNAL}>"))


def transitions() -> Column:
    later = F.transform(F.slice("secs", 2, F.size("secs")), lambda s: F.struct(
        s["section_no"].alias("no"), T.let(F.lower(T.first_sentence_ws(s["text"])), lambda x: T.contains_any(x, L.TRANSITIONS)).alias("smooth")))

    def judge(x):
        abrupt = F.filter(x, lambda v: ~v["smooth"])
        smooth = F.size(x) - F.size(abrupt)
        return F.concat(
            F.transform(abrupt, lambda v: _sig("transition", "info", -0.03, "abrupt transition", None, v["no"])),
            _collect(F.when((F.size("secs") >= 3) & (F.size(abrupt) == 0) & (smooth >= 2), _sig(
                "transition", "info", 0.05, "all section transitions are smooth", smooth))))

    return T.let(later, judge)


def specificity() -> Column:
    def section(s):
        # no two terms can overlap, so one pass counts them all
        hits = F.regexp_count(s["low"], F.lit(rf"(?<![0-9A-Za-z])(?:{'|'.join(L.VAGUE_TERMS)})(?![0-9A-Za-z])"))
        return T.let(hits / F.nullif(s["words"], F.lit(0)) * 100.0, lambda v: _collect(F.when(s["words"] >= 20, F.when(
            v > 5.0, _sig("specificity", "warning", -0.1, "high vagueness density", v, s["section_no"])).when(
            (v < 1.0) & (s["words"] >= 50), _sig("specificity", "info", 0.05, "specific language", v, s["section_no"])))))

    return _per_section(section)


def argument_flow() -> Column:
    kw = lambda s: T.content_keywords(s["text"], L.STOP_FLOW)
    last = F.size("secs")
    intro, end = F.get(F.col("secs"), F.lit(0)), F.element_at("secs", -1)
    body = F.array_distinct(F.flatten(F.transform(F.slice("secs", 2, F.greatest(last - 2, F.lit(0))), kw)))

    def judge(k):
        i, b, c = k["i"], k["b"], k["c"]
        n = F.greatest(F.size(i), F.lit(1))
        vals = F.struct(
            (F.size(F.array_intersect(i, b)) / n).alias("ib"), (F.size(F.array_intersect(i, c)) / n).alias("ic"),
            (F.size(F.array_except(F.array_except(c, i), b)) / F.greatest(F.size(c), F.lit(1))).alias("new"))
        sigs = T.let(vals, lambda v: _collect(
            F.when(v["ib"] < 0.2, _sig("argument_flow", "warning", -0.1, "weak intro-to-body connection", v["ib"] * 100.0)),
            F.when(v["ic"] < 0.2, _sig("argument_flow", "warning", -0.1, "weak intro-to-conclusion connection", v["ic"] * 100.0)),
            F.when(v["new"] > 0.5, _sig("argument_flow", "warning", -0.1, "conclusion introduces new concepts", v["new"] * 100.0, end["section_no"])),
            F.when((v["ib"] >= 0.4) & (v["ic"] >= 0.4) & (v["new"] <= 0.3), _sig("argument_flow", "info", 0.1, "strong argument flow"))))
        return F.when((F.size(i) > 0) & (F.size(c) > 0), sigs).otherwise(F.array().cast(f"array<{SIGNAL}>"))

    keys = F.struct(kw(intro).alias("i"), body.alias("b"), kw(end).alias("c"))
    return F.when(last >= 3, T.let(keys, judge)).otherwise(F.array().cast(f"array<{SIGNAL}>"))


CORE = {
    "citations": citation_recency, "word_count": word_counts, "structure": structure, "reading_level": reading_level,
    "duplicates": duplicate_paragraphs, "reference_style": reference_style,
}
DEEP = {
    "fallacies": fallacies, "hedging": hedging, "topic_sentences": topic_sentences, "counter_arguments": counter_arguments,
    "transitions": transitions, "specificity": specificity, "argument_flow": argument_flow,
}


def signals(docs: DataFrame, names=None, prepared: bool = False) -> DataFrame:
    """Signal rows of the named narrow checks (default: all of them) in one pass."""
    table = {**CORE, **DEEP}
    d = docs if prepared else prepare(docs)
    return d.select("doc_id", F.inline(F.concat(*[table[n]() for n in (names or table)])))


def number_rows(docs: DataFrame) -> DataFrame:
    """Distinct (doc_id, value, unit, number, sections, context) of the significant
    numbers; the context is the first by section."""
    n = docs.select("doc_id", F.explode("sections").alias("s")).select(
        "doc_id", F.col("s.section_no").alias("section_no"), F.posexplode(T.significant_numbers(F.col("s.text"))).alias("at", "n"))
    return n.select("doc_id", "section_no", "at", F.col("n.value").alias("value"), F.col("n.context").alias("context")).groupBy(
        "doc_id", "value").agg(
        F.array_sort(F.collect_set("section_no")).alias("in_sections"), F.min_by("context", F.struct("section_no", "at")).alias("context")).select(
        "*", T.number_unit(F.col("value")).alias("unit"), T.number_value(F.col("value")).alias("number"))


def number_consistency(docs: DataFrame) -> DataFrame:
    """Signals for numbers of one unit less than 15 % apart that never share a section.

    Range join by logarithmic buckets of ratio 1.15: candidates lie in the same or
    the next bucket, so numbers meet only their neighbours."""
    n = number_rows(docs).where("number >= 10").withColumn("bucket", F.floor(F.log("number") / F.log(F.lit(1.15))).cast("int"))
    n = settle(n.select("doc_id", "unit", "value", "number", "in_sections", "bucket"), "numbers")
    a = n.select("doc_id", "unit", F.col("value").alias("va"), F.col("number").alias("na"), F.col("in_sections").alias("sa"),
                 F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    b = n.select("doc_id", "unit", F.col("value").alias("vb"), F.col("number").alias("nb"), F.col("in_sections").alias("sb"), "bucket")
    pairs = a.join(b, ["doc_id", "unit", "bucket"]).where(
        (F.col("nb") > F.col("na")) & (F.col("nb") / F.col("na") < 1.15) & ~F.arrays_overlap("sa", "sb"))
    sig = _sig("number_consistency", "warning", -0.05, F.concat(
        F.lit("possible inconsistency: "), F.least("va", "vb"), F.lit(" vs "), F.greatest("va", "vb")), F.col("nb") / F.col("na"))
    return pairs.select("doc_id", sig.alias("x")).select("doc_id", "x.*")


def evidence_signals(items: DataFrame) -> DataFrame:
    """Evidence-quality signals from claims_and_evidence rows."""
    counts = items.groupBy("doc_id").agg(
        F.count_if(F.col("role") == "claim").alias("claims"), F.count_if(F.col("role") == "evidence").alias("evidence"),
        F.count_if(F.coalesce("quantified", F.lit(False))).alias("quantified"))
    return counts.select("doc_id", F.inline(evidence_quality()))


def validate(docs: DataFrame, items: DataFrame | None = None, deep: bool = True) -> DataFrame:
    """All signals: the core set, or core and deep."""
    out = signals(docs, list(CORE) + (list(DEEP) if deep else [])).unionByName(number_consistency(docs))
    return out if items is None else out.unionByName(evidence_signals(items))


def repeated_lines_across(documents: DataFrame, min_bytes: int = 80) -> DataFrame:
    """Paragraph keys found in several documents: (key, documents, paragraphs)."""
    one = F.array(F.struct(F.lit(1).alias("section_no"), F.col("text").alias("text")))
    keys = documents.withColumn("one", one).select("doc_id", F.explode(paragraph_keys("one", "\n")).alias("p")).select("doc_id", "p.key")
    per_doc = keys.groupBy("key", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("key").agg(F.count("*").alias("documents"), F.sum("n").alias("paragraphs")).where("documents > 1")


def deterministic_score(structural: DataFrame, core_signals: DataFrame) -> DataFrame:
    """clamp(structural + 0.05 * sum of core signal effects)."""
    effect = core_signals.groupBy("doc_id").agg(F.sum("effect").alias("effect"))
    x = F.col("structural") + 0.05 * F.coalesce("effect", F.lit(0.0))
    return structural.join(effect, "doc_id", "left").select(
        "doc_id", F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)).alias("score"))
