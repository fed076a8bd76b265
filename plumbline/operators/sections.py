"""Segmentation of documents into sections, and sections into sentence rows.

Input: documents(doc_id, text, ...). A document row keeps its sections as one
array column, so every later per-document step stays a narrow, shuffle-free
transformation; ``section_rows`` and ``sentence_rows`` give the flat tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import text as T

PAGE_BYTES = 2500
NUMBERED = r"^(\d+(?:\.\d+)*\.?)\s+(.+)$"
ALL_CAPS = r"^[A-Z][A-Z\s\d\-:,&]{2,}$"


def lines(c: Column) -> Column:
    return T.let(F.split(c, r"\r?\n"), lambda parts: F.when(
        F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def _heading(cur: Column, nxt: Column, after: Column) -> Column:
    """struct<title, level> when the (trimmed) line is a heading, else null."""
    size = F.octet_length(cur)
    numbering = F.regexp_extract(cur, NUMBERED, 1)
    title = T.ws_trim(F.regexp_extract(cur, NUMBERED, 2))
    numbered = (numbering != "") & (F.octet_length(title) < 100) & ~F.endswith(title, F.lit("."))
    caps = F.rlike(cur, F.lit(ALL_CAPS)) & (size < 80)
    implied = (
        (size < 80) & (size >= 2) & ~F.rlike(cur, F.lit("[.,;]$"))
        & F.coalesce((nxt == "") & (F.octet_length(after) > size), F.lit(False))
        & F.rlike(cur, F.lit(r"^\p{Lu}")))
    return F.when(numbered, F.struct(cur.alias("title"), T.heading_level(numbering).alias("level"))).when(
        (cur != "") & (caps | implied), F.struct(cur.alias("title"), F.lit(0).alias("level")))


def sections(c: Column) -> Column:
    """array<struct<section_no, level, title, text, word_count, page>> of a text.

    Text before the first heading is dropped; a text without headings is one
    section titled "Document"."""
    whole = F.array(F.struct(
        F.lit(1).alias("section_no"), F.lit(0).alias("level"), F.lit("Document").alias("title"),
        c.alias("text"), T.word_count(c).alias("word_count"), F.lit(1).alias("page")))

    def cut(ls):
        heads = T.let(F.transform(ls, T.ws_trim), lambda trimmed: F.filter(
            F.transform(trimmed, lambda x, i: F.struct(
                i.alias("at"), _heading(x, F.get(trimmed, i + 1), F.get(trimmed, i + 2)).alias("head"))),
            lambda h: h["head"].isNotNull()))
        return T.let(heads, lambda hs: F.when(F.size(hs) == 0, whole).otherwise(
            F.transform(F.transform(hs, lambda h, n: raw_section(ls, hs, h, n)), finish)))

    def raw_section(ls, hs, h, n):
        start, end = h["at"] + 1, F.coalesce(F.get(hs, n + 1)["at"], F.size(ls))
        before = F.when(h["at"] == 0, 0).otherwise(F.octet_length(F.array_join(F.slice(ls, 1, h["at"]), "\n")) + 1)
        return F.struct(
            (n + 1).alias("section_no"), h["head"]["level"].alias("level"), h["head"]["title"].alias("title"),
            T.ws_trim(F.array_join(F.slice(ls, start + 1, end - start), "\n")).alias("text"),
            (F.floor(before / PAGE_BYTES).cast("int") + 1).alias("page"))

    def finish(s):
        return F.struct(
            s["section_no"].alias("section_no"), s["level"].alias("level"), s["title"].alias("title"),
            s["text"].alias("text"), T.word_count(s["text"]).alias("word_count"), s["page"].alias("page"))

    return T.let(lines(c), cut)


def sectioned(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents plus ``sections``; the raw text column is dropped."""
    return documents.withColumn("sections", sections(F.col(text))).drop(text)


def single_section(documents: DataFrame, title: str = "main", text: str = "text") -> DataFrame:
    """documents with the whole text as one section (labelled samples)."""
    c = F.col(text)
    one = F.array(F.struct(
        F.lit(1).alias("section_no"), F.lit(0).alias("level"), F.lit(title).alias("title"), c.alias("text"),
        T.word_count(c).alias("word_count"), F.lit(1).alias("page")))
    return documents.withColumn("sections", one).drop(text)


def section_rows(docs: DataFrame) -> DataFrame:
    """Flat sections with ``parent_no``: the nearest earlier section of a lower level.

    Rows are in pre-order, so the flat table is the flattened tree."""
    def parent(x):
        earlier = F.filter(F.col("sections"), lambda s: (s["section_no"] < x["section_no"]) & (s["level"] < x["level"]))
        return F.get(F.reverse(earlier), F.lit(0))["section_no"]

    rows = F.transform(F.col("sections"), lambda x: F.struct(
        x["section_no"].alias("section_no"), parent(x).alias("parent_no"), x["level"].alias("level"),
        x["title"].alias("title"), x["text"].alias("text"), x["word_count"].alias("word_count"), x["page"].alias("page")))
    return docs.select("doc_id", F.inline(rows))


def sentence_rows(documents: DataFrame, split: Column) -> DataFrame:
    """(doc_id, sent_no, text) for any of the sentence splitters in functions.text."""
    return documents.select("doc_id", F.posexplode(split).alias("pos", "sentence")).select(
        "doc_id", (F.col("pos") + 1).alias("sent_no"), F.col("sentence").alias("text"))
