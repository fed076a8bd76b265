"""Genre-aware extraction (essay, tender, policy, contract) and intent routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import lexicons as L, text as T


def intent_routes(df: DataFrame, intent: str) -> DataFrame:
    """Five independent routings of an intent text; they may disagree."""
    c = F.col(intent)
    domain = T.route(c, L.DOMAIN_ROUTES, "generic")
    return df.withColumns({
        "domain": domain,
        "framework": T.route(c, L.FRAMEWORK_ROUTES, "generic_quality"),
        "genre": T.route(c, L.GENRE_ROUTES, "essay"),
        "toolset": F.when(domain.isin("academic", "tender"), domain).otherwise("generic"),
        "sectors": T.route_all(c, L.SECTOR_ROUTES),
    })


def _mark(cat: str, text: Column, quality, relevance: float) -> Column:
    ql = F.lit(quality) if isinstance(quality, float) else quality
    return F.struct(F.lit(cat).alias("category"), text.alias("text"), ql.alias("quality"), F.lit(relevance).alias("relevance"))


def _rules(genre: str, s: Column, low: Column) -> dict[str, Column]:
    has = T.contains_any
    if genre == "essay":
        return {
            "counter_arguments": has(low, L.ESSAY_COUNTER),
            "vocabulary_sophistication": has(low, L.ESSAY_VOCABULARY),
            "sentence_variety": has(low, L.ESSAY_SUBORDINATE) & (F.octet_length(s) > 30),
            "cohesion_devices": T.starts_any(low, L.ESSAY_COHESION_STARTS),
            "personal_voice": has(low, L.ESSAY_VOICE),
            "rhetorical_devices": F.endswith(s, F.lit("?")),
        }
    if genre == "tender":
        return {
            "claims": has(low, L.TENDER_CLAIMS),
            "case_studies": has(low, L.TENDER_CASES),
            "named_staff": has(s, L.TENDER_STAFF_TITLES) | (F.contains(s, F.lit("(")) & F.rlike(s, F.lit(r"^\p{Lu}"))),
            "compliance_refs": has(low, L.TENDER_COMPLIANCE),
            "quantified_outcomes": F.rlike(s, F.lit("[0-9]")) & has(low, L.TENDER_OUTCOMES),
        }
    if genre == "policy":
        return {
            "objectives": has(low, L.POLICY_OBJECTIVES),
            "predictions": has(low, L.POLICY_PREDICTIONS),
            "evidence_base": has(low, L.POLICY_EVIDENCE),
            "stakeholder_coverage": has(low, L.POLICY_STAKEHOLDERS),
            "implementation": has(low, L.POLICY_IMPLEMENTATION),
        }
    return {
        "obligations": has(low, L.CONTRACT_OBLIGATIONS),
        "conditions": has(low, L.CONTRACT_CONDITIONS),
        "definitions": has(low, L.CONTRACT_DEFINITIONS) | (F.contains(s, F.lit('"')) & F.contains(low, F.lit("means"))),
        "risk_clauses": has(low, L.CONTRACT_RISKS),
    }


def items(c: Column, *genres: str) -> Column:
    """array<struct<category, text, quality, relevance>> of one text, genre by genre; narrow.
    The text is cut into sentences once."""
    sents = F.transform(T.sentences_space(c), lambda s: F.struct(s.alias("t"), F.lower(s).alias("l")))
    return T.let(sents, lambda s: F.concat(*[_genre_items(c, s, g) for g in genres]))


def _genre_items(c: Column, sents: Column, genre: str) -> Column:
    strength = {cat: (ql, rel) for cat, ql, rel in L.CATEGORIES[genre]}

    def marks(s):
        out = []
        for cat, cond in _rules(genre, s["t"], s["l"]).items():
            ql, rel = strength[cat]
            if ql is None:
                hits = sum((F.contains(s["l"], F.lit(m)).cast("int") for m in L.ESSAY_VOCABULARY), F.lit(0))
                ql = F.least(hits * 0.3, F.lit(1.0))
            out.append(F.when(cond, _mark(cat, s["t"], ql, rel)))
        return F.array_compact(F.array(*out))

    found = F.flatten(F.transform(sents, marks))
    if genre != "essay":
        return found
    thesis = F.get(F.filter(sents, lambda s: F.octet_length(s["t"]) > 20), F.lit(0))["t"]
    topics = F.filter(
        F.transform(T.paragraphs(c), lambda p: F.get(T.sentences_space(p), F.lit(0))), lambda s: F.octet_length(s) > 10)
    cat, ql, rel = L.REPETITION
    repeated = F.transform(T.repeated_words(c), lambda r: _mark(
        cat, F.concat(F.lit('Repetition: "'), r["word"], F.lit('" appears '), r["n"].cast("string"), F.lit(" times")), ql, rel))
    return F.concat(
        F.array_compact(F.array(F.when(thesis.isNotNull(), _mark("argument_thesis", thesis, *strength["argument_thesis"])))),
        F.transform(topics, lambda s: _mark("topic_sentences", s, *strength["topic_sentences"])),
        found, repeated)


def category_summary(docs: DataFrame, genre: str) -> DataFrame:
    """Per document and category of the genre: count and best example (last of the
    best), with the overall mean quality. Input: (doc_id, items array)."""
    def one(cat):
        mine = F.filter("items", lambda x: x["category"] == cat)
        best = F.array_max(F.transform(mine, lambda x, i: F.struct(x["quality"].alias("q"), i.alias("i"), x["text"].alias("t"))))
        return F.struct(cat.alias("category"), F.size(mine).alias("n"), best["q"].alias("best_quality"), best["t"].alias("best_example"))

    n = F.size("items")
    mean = F.when(n > 0, F.aggregate("items", F.lit(0.0), lambda a, x: a + x["quality"]) / n)
    cats = T.lit_array([c for c, _, _ in L.CATEGORIES[genre]])
    return docs.select("doc_id", mean.alias("mean_quality"), F.inline(F.transform(cats, one)))


def pipeline_types(items_df: DataFrame) -> DataFrame:
    """Maps category rows to claim and evidence rows."""
    c = F.col("category")
    hard, soft = c.isin(L.CLAIM_CATEGORIES), c.isin(L.SOFT_CLAIM_CATEGORIES)
    kind = F.lit("primary_data")
    for cat, t in L.EVIDENCE_TYPES.items():
        kind = F.when(c == cat, t).otherwise(kind)
    return items_df.select(
        "doc_id", "category", "text", F.when(hard | soft, "claim").otherwise("evidence").alias("role"),
        F.when(hard | soft, F.col("quality")).alias("specificity"),
        F.when(hard, F.col("quality") > 0.5).when(soft, F.lit(False)).alias("verifiable"),
        F.when(~(hard | soft), kind).alias("evidence_type"),
        F.when(~(hard | soft), c == "quantified_outcomes").alias("quantified"))


def parse_scores(reply: Column) -> Column:
    """array<struct<id, score>> from the outermost [...] of a model reply; broken
    JSON gives an empty array."""
    body = F.regexp_extract(reply, r"(?s)\[.*\]", 0)
    parsed = F.from_json(F.when(body != "", body).otherwise(reply), "array<struct<id:string,score:double>>", {"mode": "PERMISSIVE"})
    whole = F.coalesce(parsed, F.array().cast("array<struct<id:string,score:double>>"))
    broken = F.exists(whole, lambda x: x.isNull() | x["id"].isNull() | x["score"].isNull())
    return F.when(broken, T.empty_like(whole)).otherwise(whole)


def parse_score_object(reply: Column, schema: str) -> Column:
    """Object form of a reply: a fenced json block, or the outermost {...}."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    plain = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.from_json(F.when(fenced != "", fenced).otherwise(plain), schema)
