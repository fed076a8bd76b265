"""Claims that can be looked up, and their check against reference snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import lexicons as L, text as T


def _name(w: Column) -> Column:
    bare = T.trim_non_alnum(w)
    return (F.octet_length(bare) > 2) & F.rlike(bare, F.lit(r"^\p{Lu}"))


def citation_query(c: Column) -> Column:
    """Year and capitalised words, when there are two parts or more."""
    year = F.regexp_extract(c, r"\b((?:19|20)\d{2})\b", 1)
    names = F.transform(F.filter(T.words(c), lambda w: _name(w) & ~T.trim_non_alnum(w).isin(L.NAME_STOP_CITATION)), T.trim_non_alnum)
    parts = F.concat(F.when(year != "", F.array(year)).otherwise(F.array().cast("array<string>")), names)
    return T.let(parts, lambda p: F.when(F.size(p) >= 2, F.array_join(p, " ")))


QUANTITY = r"\d+[\.\d]*\s*[%£$€MBKk]|\d+[\.\d]*\s*(?:million|billion|percent|improvement|reduction|increase)"


def statistic_query(c: Column) -> Column:
    """Up to eight words over 3 bytes around the first quantity (30 characters each
    side), when there are three or more."""
    hit = F.regexp_extract(c, rf"({QUANTITY})", 1)

    def around(h):
        at = F.position(h, c)
        start = F.greatest(at - 30, F.lit(1))
        ws = F.slice(F.filter(T.words(F.substr(c, start, at - start + F.length(h) + 30)), lambda w: F.octet_length(w) > 3), 1, 8)
        return T.let(ws, lambda x: F.when((h != "") & (F.size(x) >= 3), F.array_join(x, " ")))

    return T.let(hit, around)


def entity_query(c: Column) -> Column:
    """Up to six capitalised words, when one of them is not the first word."""
    ws = T.words(c)
    names = F.filter(ws, lambda w: _name(w) & ~T.trim_non_alnum(w).isin(L.NAME_STOP_ENTITY))
    inner = F.exists(F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), _name)
    return F.when((F.size(ws) > 1) & inner, F.array_join(F.slice(names, 1, 6), " "))


def verifiable_claims(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, claim, query) of the nodes a lookup can check."""
    c = F.coalesce("source_text", "text")
    kind = F.col("node_type")
    q = F.when(kind == "Citation", citation_query(c)).when(kind == "QuantifiedEvidence", statistic_query(c)).when(
        kind == "Evidence", entity_query(c))
    return nodes.select("doc_id", "node_id", c.alias("claim"), q.alias("query")).where("query is not null")


def verify_against_snippets(claims: DataFrame, snippets: DataFrame) -> DataFrame:
    """snippets(doc_id, node_id, snippet): share of the claim's words over 4 bytes
    found in the snippet. No lookup row: pending."""
    found = snippets.select("doc_id", "node_id", "snippet", F.lit(True).alias("looked_up"))
    d = claims.join(found, ["doc_id", "node_id"], "left")
    ws = F.filter(T.words(F.lower("claim")), lambda w: F.octet_length(w) > 4)
    low = F.lower(F.coalesce("snippet", F.lit("")))
    ratio = T.let(ws, lambda x: F.when(F.size(x) == 0, 0.0).otherwise(F.size(F.filter(x, lambda w: F.contains(low, w))) / F.nullif(F.size(x), F.lit(0))))
    long = F.octet_length(F.coalesce("snippet", F.lit(""))) >= 50
    d = d.withColumn("match_ratio", F.when(long, ratio))
    return d.select("doc_id", "node_id", "claim", "query", "match_ratio", F.when(F.col("looked_up").isNull(), "pending").when(
        F.col("match_ratio") > 0.5, "verified").otherwise("unverifiable").alias("status"))


def verification_summary(checked: DataFrame) -> DataFrame:
    """Counts per document; nothing ever yields "contradicted"."""
    s = F.col("status")
    return checked.groupBy("doc_id").agg(
        F.count("*").alias("total_claims"), F.count_if(s == "verified").alias("verified"), F.count_if(s == "unverifiable").alias("unverifiable"),
        F.lit(0).cast("bigint").alias("contradicted"), F.count_if(s == "pending").alias("pending"))
