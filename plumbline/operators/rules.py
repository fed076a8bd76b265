"""Facts mined from argument graphs by relational rules (set semantics), plus
caller-supplied rules and quality constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from plumbline.operators.graph import CLAIM_TYPES, EVIDENCE_TYPES
from plumbline.session import cut_lineage

FACTS = [
    "StrongClaim", "WeakClaim", "UnsupportedClaim", "SophisticatedArgument",
    "EvidencedThesis", "QuantifiedSupport", "CitationSupport", "DeepChain",
]


def _typed(nodes: DataFrame, types) -> DataFrame:
    return nodes.where(F.col("node_type").isin(types)).select("doc_id", "node_id").distinct()


def _links(edges: DataFrame, kind: str, src: str, dst: str) -> DataFrame:
    return edges.where(F.col("edge_type") == kind).select(
        "doc_id", F.col("src").alias(src), F.col("dst").alias(dst)).distinct()


def _fact(df: DataFrame, node: str, name: str) -> DataFrame:
    return df.select("doc_id", F.col(node).alias("node_id"), F.lit(name).alias("fact")).distinct()


def evidence_per_claim(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Claims with their number of distinct evidence supporters (0 kept).

    Supporters are counted per claim before claims are looked up, so a claim
    holding a large share of all edges reaches its task as partial counts."""
    ev = _typed(nodes, EVIDENCE_TYPES).withColumnRenamed("node_id", "src")
    counted = (
        _links(edges, "Supports", "src", "dst").join(ev, ["doc_id", "src"], "left_semi")
        .groupBy("doc_id", F.col("dst").alias("node_id")).agg(F.count("*").alias("n")))
    return _typed(nodes, CLAIM_TYPES).join(counted, ["doc_id", "node_id"], "left").fillna(0, subset=["n"])


def strong_claims(nodes, edges):
    return _fact(evidence_per_claim(nodes, edges).where("n >= 2"), "node_id", "StrongClaim")


def weak_claims(nodes, edges):
    return _fact(evidence_per_claim(nodes, edges).where("n = 1"), "node_id", "WeakClaim")


def unsupported_claims(nodes, edges):
    return _fact(evidence_per_claim(nodes, edges).where("n = 0"), "node_id", "UnsupportedClaim")


def sophisticated_arguments(nodes, edges):
    thesis = _typed(nodes, ["Thesis"]).withColumnRenamed("node_id", "thesis")
    countered = _links(edges, "Counters", "counter", "thesis").join(thesis, ["doc_id", "thesis"], "left_semi")
    rebutted = _links(edges, "Rebuts", "rebuttal", "counter").select("doc_id", "counter")
    return _fact(countered.join(rebutted, ["doc_id", "counter"], "left_semi"), "thesis", "SophisticatedArgument")


def evidenced_theses(nodes, edges):
    ev = _typed(nodes, EVIDENCE_TYPES)
    links = _links(edges, "Supports", "src", "dst")
    backed = links.join(ev.withColumnRenamed("node_id", "src"), ["doc_id", "src"], "left_semi")
    one_hop = backed.select("doc_id", F.col("dst").alias("node_id"))
    two_hop = links.join(
        backed.select("doc_id", F.col("dst").alias("src")), ["doc_id", "src"], "left_semi").select(
        "doc_id", F.col("dst").alias("node_id"))
    hit = one_hop.unionByName(two_hop).join(_typed(nodes, ["Thesis"]), ["doc_id", "node_id"], "left_semi")
    return _fact(hit, "node_id", "EvidencedThesis")


def _supporting(nodes, edges, kind, name):
    links = _links(edges, "Supports", "node_id", "dst").select("doc_id", "node_id")
    return _fact(_typed(nodes, [kind]).join(links, ["doc_id", "node_id"], "left_semi"), "node_id", name)


def quantified_support(nodes, edges):
    return _supporting(nodes, edges, "QuantifiedEvidence", "QuantifiedSupport")


def citation_support(nodes, edges):
    return _supporting(nodes, edges, "Citation", "CitationSupport")


def deep_chains(nodes, edges):
    links = _links(edges, "Supports", "src", "dst")
    thesis = _typed(nodes, ["Thesis"]).withColumnRenamed("node_id", "dst")
    mids = links.join(thesis, ["doc_id", "dst"], "left_semi").select("doc_id", F.col("src").alias("dst"))
    ev = _typed(nodes, EVIDENCE_TYPES).withColumnRenamed("node_id", "src")
    return _fact(
        links.join(mids, ["doc_id", "dst"], "left_semi").join(ev, ["doc_id", "src"], "left_semi"), "src", "DeepChain")


DEFAULT_RULES = {
    "StrongClaim": strong_claims, "WeakClaim": weak_claims, "UnsupportedClaim": unsupported_claims,
    "SophisticatedArgument": sophisticated_arguments, "EvidencedThesis": evidenced_theses,
    "QuantifiedSupport": quantified_support, "CitationSupport": citation_support, "DeepChain": deep_chains,
}


def derive(nodes: DataFrame, edges: DataFrame, rules: dict | None = None) -> DataFrame:
    """(doc_id, node_id, fact) of all rules; a rule is fn(nodes, edges) -> that shape."""
    parts = [fn(nodes, edges).select("doc_id", "node_id", F.lit(name).alias("fact")) for name, fn in (rules or DEFAULT_RULES).items()]
    return reduce(DataFrame.unionByName, parts)


#: Bits of a node: its types, and what its edges say.
CLAIM, EVIDENCE, THESIS, QUANTIFIED, CITATION = 1, 2, 4, 8, 16
SUPPORTING, REBUTTED, KNOWN = 32, 64, 128
#: Bits that neighbours give: an evidence node supports it; a rebutted node counters it; it supports a
#: thesis; (second round) something that evidence supports supports it; it supports what supports a thesis.
BACKED, ANSWERED, BEFORE_THESIS, BACKED_TWICE, BEFORE_BEFORE = 256, 512, 1024, 2048, 4096


def node_bits(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, node_id, bits, n): what a node is, what its neighbours are, two steps far, and
    the number of distinct evidence nodes that support it.

    Nodes and edges are read once. Types are bits; two rounds of bit_or bring them over the
    edges, each partially combined before its shuffle, so a node that holds a large
    share of the edges reaches its task as partial results."""
    flag = lambda when, bit: F.when(when, bit).otherwise(0)
    has = lambda c, bit: F.col(c).bitwiseAND(F.lit(bit)) != 0
    t, key = F.col("node_type"), ["doc_id", "node_id"]
    types = {CLAIM: CLAIM_TYPES, EVIDENCE: EVIDENCE_TYPES, THESIS: ["Thesis"], QUANTIFIED: ["QuantifiedEvidence"], CITATION: ["Citation"]}
    typed = nodes.select(*key, reduce(lambda a, b: a.bitwiseOR(b), [flag(t.isin(list(v)), k) for k, v in types.items()], F.lit(KNOWN)).alias("bits"))
    kind = F.col("edge_type")
    e = cut_lineage(edges.where(kind.isin("Supports", "Counters", "Rebuts")).select("doc_id", "src", "dst", kind.alias("kind")).distinct())
    said = e.where("kind <> 'Counters'").select("doc_id", F.inline(F.array(
        F.struct(F.col("src").alias("node_id"), flag(F.col("kind") == "Supports", SUPPORTING).alias("bits")),
        F.struct(F.col("dst").alias("node_id"), flag(F.col("kind") == "Rebuts", REBUTTED).alias("bits")))))
    own = cut_lineage(typed.unionByName(said).groupBy(*key).agg(F.bit_or("bits").alias("bits")))
    end = lambda df, bits, node: df.select("doc_id", F.col("node_id").alias(node), F.col("bits").alias(bits))
    both = e.where("kind <> 'Rebuts'").join(end(own, "src_bits", "src"), ["doc_id", "src"]).join(end(own, "dst_bits", "dst"), ["doc_id", "dst"])
    supports, evidence, thesis = F.col("kind") == "Supports", has("src_bits", EVIDENCE), has("dst_bits", THESIS)
    both = cut_lineage(both.where(supports | (thesis & has("src_bits", REBUTTED))))
    row = lambda node, bits, n=F.lit(0): F.struct(F.col(node).alias("node_id"), bits.alias("bits"), n.cast("long").alias("n"))
    first = both.select("doc_id", F.inline(F.array(
        row("dst", F.when(supports, flag(evidence, BACKED)).otherwise(ANSWERED), flag(supports & evidence, 1)), row("src", flag(supports & thesis, BEFORE_THESIS)))))
    first = cut_lineage(first.where("bits > 0").groupBy(*key).agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n")))
    links = both.where(supports)
    backed = links.where(thesis).join(end(first, "b", "src").where(has("b", BACKED)), ["doc_id", "src"]).select("doc_id", F.col("dst").alias("node_id"), F.lit(BACKED_TWICE).alias("bits"))
    deep = links.where(evidence).join(end(first, "b", "dst").where(has("b", BEFORE_THESIS)), ["doc_id", "dst"]).select("doc_id", F.col("src").alias("node_id"), F.lit(BEFORE_BEFORE).alias("bits"))
    none = F.lit(0).cast("long")
    every = own.withColumn("n", none).unionByName(first).unionByName(backed.unionByName(deep).withColumn("n", none))
    return every.groupBy(*key).agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))


def mine_facts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of the facts of DEFAULT_RULES per document, from the nodes' bits. There is no
    rule for circular arguments: constant 0."""
    all_of = lambda *bits: F.col("bits").bitwiseAND(F.lit(sum(bits))) == sum(bits)
    any_of = lambda *bits: F.col("bits").bitwiseAND(F.lit(sum(bits))) != 0
    n = F.col("n")
    c = {
        "StrongClaim": all_of(CLAIM) & (n >= 2), "WeakClaim": all_of(CLAIM) & (n == 1), "UnsupportedClaim": all_of(CLAIM) & (n == 0),
        "SophisticatedArgument": all_of(THESIS, ANSWERED), "EvidencedThesis": all_of(THESIS) & any_of(BACKED, BACKED_TWICE),
        "QuantifiedSupport": all_of(QUANTIFIED, SUPPORTING), "CitationSupport": all_of(CITATION, SUPPORTING), "DeepChain": all_of(EVIDENCE, BEFORE_BEFORE)}
    counts = node_bits(nodes, edges).groupBy("doc_id").agg(F.max(all_of(KNOWN)).alias("known"), *[F.count_if(x).alias(f) for f, x in c.items()]).where("known")
    c = {f: F.col(f) for f in FACTS}
    return counts.select(
        "doc_id", c["StrongClaim"].alias("strong_claims"), c["WeakClaim"].alias("weak_claims"),
        c["UnsupportedClaim"].alias("unsupported_claims"), (c["StrongClaim"] + c["WeakClaim"]).alias("supported_claims"),
        c["SophisticatedArgument"].alias("sophisticated_arguments"), F.lit(0).cast("bigint").alias("circular_arguments"),
        (c["EvidencedThesis"] > 0).alias("evidenced_thesis"), (c["EvidencedThesis"] == 0).alias("unevidenced_thesis"),
        c["QuantifiedSupport"].alias("quantified_support"), c["CitationSupport"].alias("citation_support"),
        c["DeepChain"].alias("deep_chains"))


def facts_to_features(facts: DataFrame, total_claims: str) -> DataFrame:
    tc = F.greatest(F.col(total_claims), F.lit(1)).cast("double")
    return facts.select("doc_id", F.array(
        F.col("strong_claims") / tc, F.col("weak_claims") / tc, F.col("unsupported_claims") / tc,
        F.col("evidenced_thesis").cast("double"), (F.col("sophisticated_arguments") > 0).cast("double"),
        F.col("quantified_support").cast("double"), F.col("citation_support").cast("double"),
        F.col("deep_chains").cast("double")).alias("features"))


def quality_violations(criteria: DataFrame, scores: DataFrame, agents: DataFrame, needs: DataFrame,
                       extra: list[tuple[str, str, DataFrame]] | None = None) -> DataFrame:
    """(rule, severity, subject): criteria without any score, agents without any
    need, and caller rules given as (name, severity, DataFrame(subject))."""
    found = [
        ("criterion_scored", "error", criteria.join(scores.select("criterion_id").distinct(), "criterion_id", "left_anti")
         .select(F.col("criterion_id").cast("string").alias("subject"))),
        ("agent_has_needs", "warning", agents.join(needs.select("agent_id").distinct(), "agent_id", "left_anti")
         .select(F.col("agent_id").cast("string").alias("subject"))),
        *(extra or []),
    ]
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(name).alias("rule"), F.lit(sev).alias("severity"), "subject") for name, sev, df in found])
