"""Entity tables as (s, p, o, o_kind, datatype) triples, and queries over triples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import text as T
from plumbline.operators import extraction

COLUMNS = ["s", "p", "o", "o_kind", "datatype"]
NUMBER, WHOLE, FLAG, TIME = "decimal", "integer", "boolean", "dateTime"


def iri(space: str, *parts) -> Column:
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat(F.lit(f"{space}:"), F.concat_ws("_", *[T.iri_safe(c.cast("string")) for c in cols]))


def entity_rows(type_name: str, literals: dict[str, tuple] | None = None, links: dict[str, Column] | None = None) -> Column:
    """array<struct<p, o, o_kind, datatype>> of an entity: type, literals {predicate: (column,
    datatype)} and links {predicate: target iri}."""
    def row(p, o, kind, dt):
        return F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).cast("string").alias("datatype"))

    rows = [row("type", F.lit(type_name), "iri", None)]
    rows += [row(p, F.col(c) if isinstance(c, str) else c, "literal", dt) for p, (c, dt) in (literals or {}).items()]
    rows += [row(p, o, "iri", None) for p, o in (links or {}).items()]
    return F.array(*rows)


def entity(df: DataFrame, subject: Column, type_name: str, literals: dict[str, tuple] | None = None, links: dict[str, Column] | None = None) -> DataFrame:
    """Unpivots one entity table; null values give no triple."""
    return df.select(subject.alias("s"), F.inline(entity_rows(type_name, literals, links))).where("o is not null")


def union(*parts: DataFrame) -> DataFrame:
    """Union with set semantics."""
    return reduce(DataFrame.unionByName, parts).distinct()


def concat(*parts: DataFrame) -> DataFrame:
    """Union of tables whose subjects are unique already: no shuffle."""
    return reduce(DataFrame.unionByName, parts)


def documents(df: DataFrame) -> DataFrame:
    return entity(df, iri("doc", "doc_id"), "Document", {"title": ("title", None), "docType": ("doc_type", None), "totalWordCount": ("word_count", WHOLE)})


def section_iri() -> Column:
    return iri("doc", "doc_id", F.concat(F.lit("s"), "section_no"))


def _section_rows() -> Column:
    return entity_rows("Section", {"title": ("title", None), "text": ("text", None), "wordCount": ("word_count", WHOLE)}, {"parentDocument": iri("doc", "doc_id")})


def sections(df: DataFrame) -> DataFrame:
    return df.select(section_iri().alias("s"), F.inline(_section_rows())).where("o is not null")


def item_iri() -> Column:
    return iri("doc", "doc_id", F.concat(F.lit("s"), "section_no"), F.concat(F.lit("i"), "item_no"))


def _item_rows() -> Column:
    claim = entity_rows("Claim", {
        "text": ("text", None), "specificity": ("specificity", NUMBER), "verifiable": ("verifiable", FLAG)}, {"inSection": section_iri()})
    evidence = entity_rows("Evidence", {
        "source": ("source", None), "evidenceType": ("evidence_type", None), "text": ("text", None), "hasQuantifiedOutcome": ("quantified", FLAG)},
        {"inSection": section_iri()})
    return F.when(F.col("role") == "claim", claim).when(F.col("role") == "evidence", evidence)


def claims_evidence(df: DataFrame) -> DataFrame:
    """Rows of extraction.claims_and_evidence, in one pass."""
    return df.select(item_iri().alias("s"), F.inline(_item_rows())).where("o is not null")


def section_triples(docs: DataFrame) -> DataFrame:
    """Triples of documents' sections (extraction.with_items) and of their claims and
    evidence: the text is segmented and read for items once."""
    s = docs.select("doc_id", F.explode("sections").alias("x"))
    # Each section is a row without an item, before the rows of its items.
    items = F.col("x.items")
    every = s.select("doc_id", F.col("x.section_no").alias("section_no"), "x.title", F.col("x.text").alias("section_text"), "x.word_count", F.posexplode(
        F.concat(F.array(F.lit(None).cast(s.schema["x"].dataType["items"].dataType.elementType)), items)).alias("pos", "i"))
    rows = extraction.claims_and_evidence(every.select("*", (F.col("pos") - 1).alias("item_no"), "i.*"), "pos", "title", "section_text", "word_count")
    own = F.col("pos") == 0
    rows = rows.withColumn("text", F.when(own, F.col("section_text")).otherwise(F.col("text")))
    return rows.select(F.when(own, section_iri()).otherwise(item_iri()).alias("s"), F.inline(F.when(own, _section_rows()).otherwise(_item_rows()))).where("o is not null")


def criteria(df: DataFrame) -> DataFrame:
    f = entity(df.select("framework_id", "framework_name", "pass_mark").distinct(), iri("crit", "framework_id"), "EvaluationFramework", {
        "name": ("framework_name", None), "passMark": ("pass_mark", NUMBER)})
    c = entity(df, iri("crit", "criterion_id"), "EvaluationCriterion", {
        "title": ("title", None), "description": ("description", None), "maxScore": ("max_score", NUMBER), "weight": ("weight", NUMBER)},
        {"partOf": iri("crit", "framework_id")})
    return f.unionByName(c)


def rubric_levels(df: DataFrame) -> DataFrame:
    """(criterion_id, level_no, level, score_range, descriptor)"""
    return entity(df, iri("crit", "criterion_id", F.concat(F.lit("L"), "level_no")), "RubricLevel", {
        "level": ("level", None), "scoreRange": ("score_range", None), "descriptor": ("descriptor", None)}, {"criterion": iri("crit", "criterion_id")})


def agents(df: DataFrame) -> DataFrame:
    return entity(df, iri("agent", "agent_id"), "EvaluatorAgent", {"name": ("name", None), "role": ("role", None), "domain": ("expertise", None)})


def needs(df: DataFrame) -> DataFrame:
    """(agent_id, need_no, need_type, expression, salience, satisfied)"""
    return entity(df, iri("agent", "agent_id", F.lit("Need"), "need_no"), "Need", {
        "needType": ("need_type", None), "expression": ("expression", None), "salience": ("salience", NUMBER), "satisfied": ("satisfied", FLAG)},
        {"agentRef": iri("agent", "agent_id")})


def trust(df: DataFrame) -> DataFrame:
    return entity(df, iri("agent", "truster", F.lit("Trust"), "trustee"), "TrustRelation", {"trustLevel": ("trust_level", NUMBER)},
                  {"truster": iri("agent", "truster"), "trustee": iri("agent", "trustee")})


def scores(df: DataFrame) -> DataFrame:
    me = iri("agent", "session_id", "agent_id", F.lit("Score"), "criterion_id", F.concat(F.lit("R"), "round"))
    return entity(df, me, "Score", {"score": ("score", NUMBER), "maxScore": ("max_score", NUMBER), "round": ("round", WHOLE)},
                  {"agent": iri("agent", "agent_id"), "criterion": iri("crit", "criterion_id")})


def challenges(df: DataFrame) -> DataFrame:
    me = iri("agent", "session_id", "challenger", F.lit("challenges"), "target", "criterion_id", "seq")
    return entity(df, me, "Challenge", {"round": ("round", WHOLE), "scoreFrom": (F.when(F.col("score_to").isNotNull(), F.col("score_from")), NUMBER),
                                        "scoreTo": ("score_to", NUMBER)},
                  {"challenger": iri("agent", "challenger"), "target": iri("agent", "target"), "criterion": iri("crit", "criterion_id")})


def alignments(df: DataFrame) -> DataFrame:
    me = iri("doc", "doc_id", F.concat(F.lit("s"), "section_no"), F.lit("to"), "criterion_id")
    return entity(df, me, "Alignment", {"confidence": ("confidence", NUMBER)}, {"alignedFrom": section_iri(), "criterion": iri("crit", "criterion_id")})


def signals(df: DataFrame) -> DataFrame:
    """check signals numbered per document (signal_no)"""
    return entity(df, iri("val", "doc_id", "signal_no"), "ValidationSignal", {
        "title": ("title", None), "severity": ("severity", None), "effect": ("effect", NUMBER)}, {"document": iri("doc", "doc_id")})


def predictions(df: DataFrame) -> DataFrame:
    return entity(df, iri("pred", "doc_id", "prediction_no"), "Prediction", {
        "text": ("text", None), "predictionType": ("prediction_type", None), "credibility": ("credibility", NUMBER), "verdict": ("verdict", None)})


def guidelines(df: DataFrame) -> DataFrame:
    g = entity(df, iri("guide", "guideline_no"), "Guideline", {"title": ("title", None), "source": ("source", None), "sector": ("sector", None), "relevance": ("relevance", NUMBER)})
    k = df.select("guideline_no", F.posexplode("key_criteria").alias("i", "text"))
    return g.unionByName(entity(k, iri("guide", "guideline_no", "i"), "GuidelineCriterion", {"text": ("text", None)}, {"partOf": iri("guide", "guideline_no")}))


def anchors(df: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, score, profile array) with one predicate per profile feature"""
    feats = {n: (F.col("profile")[i], NUMBER) for i, n in enumerate(names)}
    return entity(df, iri("cal", "doc_id"), "AnchorEssay", {"score": ("score", NUMBER), **feats})


def argument_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = entity(nodes, F.concat_ws("|", F.col("doc_id").cast("string"), "node_id"), "Node", {"nodeType": ("node_type", None), "hasText": ("text", None), "hasScore": ("score", NUMBER)})
    e = edges.select(F.concat_ws("|", F.col("doc_id").cast("string"), "src").alias("s"), F.lower("edge_type").alias("p"),
                     F.concat_ws("|", F.col("doc_id").cast("string"), "dst").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("datatype"))
    return n.unionByName(e)


def sessions(df: DataFrame) -> DataFrame:
    """(session_id, document, framework, created_at) with final scores elsewhere"""
    return entity(df, iri("eval", "session_id"), "EvaluationSession", {"document": ("document", None), "framework": ("framework", None), "createdAt": ("created_at", TIME)})


def ntriples(triples: DataFrame) -> DataFrame:
    """One N-Triples line per triple; names become <urn:...> identifiers."""
    ref = lambda c: F.concat(F.lit("<urn:"), c, F.lit(">"))
    obj = F.when(F.col("o_kind") == "iri", ref(F.col("o"))).otherwise(F.concat(
        F.lit('"'), T.escape_literal(F.col("o")), F.lit('"'),
        F.coalesce(F.concat(F.lit("^^<http://www.w3.org/2001/XMLSchema#"), "datatype", F.lit(">")), F.lit(""))))
    return triples.select(F.concat_ws(" ", ref(F.col("s")), ref(F.col("p")), obj, F.lit(".")).alias("value"))


# --- queries ------------------------------------------------------------------
def wide(triples: DataFrame, type_name: str, predicates: list[str]) -> DataFrame:
    """Subjects of a type with the given predicates as columns (all required)."""
    p = triples.where(F.col("p").isin(["type", *predicates]))
    w = p.groupBy("s").pivot("p", ["type", *predicates]).agg(F.first("o"))
    return w.where(F.col("type") == type_name).dropna(subset=predicates).drop("type")


def section_matches(triples: DataFrame) -> DataFrame:
    return wide(triples, "Section", ["title", "text", "wordCount"]).withColumn("wordCount", F.col("wordCount").cast("bigint"))


def section_claims(triples: DataFrame, section: str | None = None) -> DataFrame:
    w = wide(triples, "Claim", ["text", "specificity", "verifiable", "inSection"])
    w = w.withColumns({"specificity": F.col("specificity").cast("double"), "verifiable": F.col("verifiable").cast("boolean")})
    return w if section is None else w.where(F.col("inSection") == section)


def section_evidence(triples: DataFrame, section: str | None = None) -> DataFrame:
    w = wide(triples, "Evidence", ["source", "evidenceType", "hasQuantifiedOutcome", "inSection"]).withColumn(
        "hasQuantifiedOutcome", F.col("hasQuantifiedOutcome").cast("boolean"))
    return w if section is None else w.where(F.col("inSection") == section)


def embeddable_entities(triples: DataFrame) -> DataFrame:
    """(s, label) of every title, text or name literal."""
    return triples.where(F.col("p").isin("title", "text", "name") & (F.col("o_kind") == "literal") & (F.col("o") != "")).select(
        "s", F.col("p").alias("field"), F.col("o").alias("label"))


# type keyword -> (node type, group, size); first hit wins; fixed values
NODE_KINDS = [
    ("Document", "Document", 0, 24.0), ("Section", "Section", 0, 12.0), ("Claim", "Claim", 0, 8.0), ("Evidence", "Evidence", 0, 8.0),
    ("EvaluationFramework", "Framework", 1, 20.0), ("EvaluationCriterion", "Criterion", 1, 14.0), ("RubricLevel", "RubricLevel", 1, 6.0),
    ("EvaluatorAgent", "Agent", 2, 16.0), ("Need", "Need", 2, 6.0), ("TrustRelation", "Trust", 2, 5.0), ("ModeratedScore", "Moderated", 5, 14.0),
    ("Score", "Score", 3, 12.0), ("Challenge", "Challenge", 4, 10.0),
]
EDGE_KINDS = [
    ("structural", ["contains", "partOf"]), ("trust", ["trust"]), ("challenge", ["challeng"]), ("scores", ["score"]), ("evaluates", ["align"]),
]


def _kind(pos: int, default) -> Column:
    e = None
    for row in NODE_KINDS:
        hit = F.contains(F.col("type"), F.lit(row[0]))
        e = F.when(hit, F.lit(row[pos])) if e is None else e.when(hit, F.lit(row[pos]))
    return e.otherwise(F.lit(default))


def kg_edges(triples: DataFrame) -> DataFrame:
    kind = None
    for name, keys in EDGE_KINDS:
        hit = T.contains_any(F.col("p"), keys)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return triples.where("p <> 'type' and o_kind = 'iri'").select(
        F.col("s").alias("source"), F.col("o").alias("target"), F.col("p").alias("label"), kind.otherwise("relation").alias("edge_type"))


def kg_nodes(triples: DataFrame) -> DataFrame:
    """Every subject and linked object with its type, group, size, label, number of
    properties and number of distinct neighbours.

    All facts about a node come from one pass over the triples and are aggregated once by id; property and
    neighbour lists stay rows (triples, kg_edges), so hubs gather nothing."""
    none = F.lit(None).cast("string")
    t = F.col("p") == "type"
    named = F.col("p").isin("title", "name", "label") & (F.col("o_kind") == "literal")
    link = (F.col("o_kind") == "iri") & ~t
    own = F.struct(
        F.col("s").alias("id"), F.when(t, F.col("o")).alias("type"), F.when(named, F.col("o")).alias("name"),
        (F.col("o_kind") == "literal").cast("int").alias("props"), F.when(link, F.col("o")).alias("near"))
    back = F.when(link, F.struct(F.col("o").alias("id"), none.alias("type"), none.alias("name"), F.lit(0).alias("props"), F.col("s").alias("near")))
    both = triples.select(F.inline(F.array_compact(F.array(own, back))))
    n = both.groupBy("id").agg(
        F.min("type").alias("type"), F.min("name").alias("name"), F.sum("props").alias("properties"), F.countDistinct("near").alias("neighbours"))
    n = n.withColumn("type", F.coalesce("type", F.lit("")))
    return n.select("id", F.coalesce("name", F.regexp_replace("id", "^.*[:/#]", "")).alias("label"), _kind(1, "default").alias("node_type"),
                    _kind(2, 6).alias("node_group"), _kind(3, 8.0).alias("size"), "properties", "neighbours")
