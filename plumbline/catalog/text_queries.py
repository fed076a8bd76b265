"""Queries over segmentation and text features (P) and rule extraction (X)."""

from pyspark.sql import functions as F

from plumbline.catalog.base import (
    CTE, any_of, big, jac, marked_documents, occ_total, q, r6, register, section_documents, sents_dot, sql_list, starts_any, table,
    trim, words)
from plumbline.functions import lexicons as L, text as T
from plumbline.functions.text import WS_CLASS
from plumbline.operators import adaptive, extraction, sections

docs = lambda s, d: table(s, d, "documents").select("doc_id", "text")


# --- P1/P2/P4 sections -------------------------------------------------------
CTE["sec_lines"] = """
  SELECT doc_id, doc_type, i, line, trim_line AS t,
         lead(trim_line, 1) OVER w AS n1, lead(trim_line, 2) OVER w AS n2,
         coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT doc_id, doc_type, i, line, %s AS trim_line FROM
        (SELECT doc_id, doc_type, unnest(string_split(stext, chr(10))) AS line,
                generate_subscripts(string_split(stext, chr(10)), 1) AS i FROM sec_docs))
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)""" % trim("line")
_NUMRE = r"'^(\d+(?:\.\d+)*\.?)\s+(.+)$'"
CTE["sec_marks"] = f"""
  SELECT *, num <> '' AND strlen(ttl) < 100 AND NOT ends_with(ttl, '.') AS numbered FROM
    (SELECT *, regexp_extract(t, {_NUMRE}, 1) AS num, {trim(f"regexp_extract(t, {_NUMRE}, 2)")} AS ttl FROM sec_lines)"""
CTE["sec_heads"] = r"""
  SELECT *, sum(h) OVER (PARTITION BY doc_id ORDER BY i) AS section_no FROM (
  SELECT *, CASE WHEN numbered THEN 1 WHEN t <> '' AND (
      (regexp_matches(t, '^[A-Z][A-Z\s\d\-:,&]{2,}$') AND strlen(t) < 80)
      OR (strlen(t) < 80 AND strlen(t) >= 2 AND NOT regexp_matches(t, '[.,;]$') AND coalesce(n1 = '' AND strlen(n2) > strlen(t), false)
          AND regexp_matches(t, '^\p{Lu}'))) THEN 1 ELSE 0 END AS h FROM sec_marks)"""
CTE["secs"] = f"""
  SELECT h.doc_id, h.doc_type, h.section_no, h.t AS title,
         CASE WHEN h.numbered THEN len(string_split(rtrim(h.num, '.'), '.')) - 1 ELSE 0 END AS level,
         {trim("coalesce(b.body, '')")} AS text, h.before // 2500 + 1 AS page
  FROM sec_heads h LEFT JOIN (SELECT doc_id, section_no, string_agg(line, chr(10) ORDER BY i) AS body FROM sec_heads
                              WHERE h = 0 AND section_no > 0 GROUP BY ALL) b
       ON h.doc_id = b.doc_id AND h.section_no = b.section_no
  WHERE h.h = 1"""
CTE["secs_wc"] = f"SELECT *, len({words('text')}) AS word_count FROM secs"


@register("p1_sections", f"""
  SELECT doc_id, {big('section_no')} AS section_no, {big('level')} AS level, title, md5(text) AS body, {big('word_count')} AS word_count,
         {big('page')} AS page FROM secs_wc""")
def _p1(s, d):
    rows = sections.section_rows(sections.sectioned(section_documents(s, d)))
    return rows.select("doc_id", "section_no", "level", "title", F.md5(F.col("text").cast("binary")).alias("body"), "word_count", "page")


@register("p7_section_parents", f"""
  SELECT s.doc_id, {big('s.section_no')} AS section_no, {big('max(p.section_no)')} AS parent_no
  FROM secs s LEFT JOIN secs p ON p.doc_id = s.doc_id AND p.section_no < s.section_no AND p.level < s.level GROUP BY s.doc_id, s.section_no""")
def _p7(s, d):
    return sections.section_rows(sections.sectioned(section_documents(s, d))).select("doc_id", "section_no", "parent_no")


@register("p3_word_count", f"SELECT doc_id, {big('len(' + words('text') + ')')} AS words FROM documents")
def _p3(s, d):
    return docs(s, d).select("doc_id", T.word_count(F.col("text")).alias("words"))


def _sent_sql(expr, src="documents"):
    return (f"SELECT doc_id, {big('sent_no')} AS sent_no, md5(x) AS sentence FROM (SELECT doc_id, unnest(l) AS x, "
            f"generate_subscripts(l, 1) AS sent_no FROM (SELECT doc_id, {expr} AS l FROM {src}))")


def _sent(s, d, split):
    return sections.sentence_rows(docs(s, d), split).select(
        "doc_id", "sent_no", F.md5(F.col("text").cast("binary")).alias("sentence"))


@register("p5a_sentences_dot15", _sent_sql(sents_dot("text", 15)))
def _p5a(s, d):
    return _sent(s, d, T.sentences_dot(F.col("text"), 15))


@register("p5b_sentences_dot10", _sent_sql(sents_dot("text", 10)))
def _p5b(s, d):
    return _sent(s, d, T.sentences_dot(F.col("text"), 10))


# RE2 has no lookbehind: mark the boundary, then split on the mark
def sents_space(x):
    return (f"list_filter(list_transform(string_split(regexp_replace({x}, '([.?!]) ', '\\1' || chr(1), 'g'), chr(1)), "
            f"lambda s: {trim('s')}), lambda s: s <> '')")


def sents_ws_found(x):
    return (f"list_filter(list_transform(regexp_extract_all(regexp_replace({x}, '([.!?])([ \\n])', '\\1' || chr(1) || '\\2', 'g') || chr(1), "
            f"'(?s)[^\\x01]*?[.!?]\\x01', 0), lambda s: {trim("rtrim(s, chr(1))")}), lambda s: s <> '')")


def sents_ws(x):
    f = sents_ws_found(x)
    return f"(CASE WHEN len({f}) > 0 THEN {f} WHEN {trim(x)} <> '' THEN [{trim(x)}] ELSE [] END)"


@register("p5c_sentences_space", _sent_sql(sents_space("text")))
def _p5c(s, d):
    return _sent(s, d, T.sentences_space(F.col("text")))


@register("p5d_sentences_ws", _sent_sql(sents_ws("text")))
def _p5d(s, d):
    return _sent(s, d, T.sentences_ws(F.col("text")))


PARAS = f"list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda s: {trim('s')}), lambda s: s <> '')"


@register("p6_paragraphs", _sent_sql(PARAS.replace("text", "stext"), "sec_docs"))
def _p6(s, d):
    return sections.sentence_rows(section_documents(s, d), T.paragraphs(F.col("text"))).select(
        "doc_id", "sent_no", F.md5(F.col("text").cast("binary")).alias("sentence"))


@register("p8_iri_escape_truncate", f"""
  SELECT doc_id, md5(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_]', '_', 'g')) AS iri,
         md5(replace(replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')) AS esc,
         CASE WHEN length(text) <= 200 THEN text WHEN contains(text[:200], ' ') THEN regexp_extract(text[:200], '(?s)^(.*) ', 1)
              ELSE text[:200] END AS head
  FROM documents""")
def _p8(s, d):
    return docs(s, d).select(
        "doc_id", F.md5(T.iri_safe(F.col("text")).cast("binary")).alias("iri"), F.md5(T.escape_literal(F.col("text")).cast("binary")).alias("esc"),
        T.truncate_words(F.col("text"), 200).alias("head"))


def kw_list(x, stop):
    return (f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), "
            f"lambda w: strlen(w) > 2 AND NOT list_contains({sql_list(stop)}, w))")


def kw_set(x, stop):
    return f"list_distinct({kw_list(x, stop)})"


NA_TRIM = "regexp_replace(w, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')"


def kw_content(x, stop):
    return (f"list_distinct(list_filter(list_transform({words(f'lower({x})')}, lambda w: {NA_TRIM}), "
            f"lambda w: strlen(w) > 4 AND NOT list_contains({sql_list(stop)}, w)))")


@register("p9_keywords", f"""
  SELECT doc_id, {big('len(a)')} AS set_n, array_to_string(list_sort(a), ' ') AS set_words, {big('len(b)')} AS list_n,
         array_to_string(list_sort(b), ' ') AS list_words, {big('len(c)')} AS content_n, array_to_string(list_sort(c), ' ') AS content_words
  FROM (SELECT doc_id, {kw_set('text', L.STOP_ALIGN)} AS a, {kw_list('text', L.STOP_PREDICT)} AS b,
               {kw_content('text', L.STOP_FLOW)} AS c FROM documents)""")
def _p9(s, d):
    k = docs(s, d).select(
        "doc_id", T.keywords_set(F.col("text"), L.STOP_ALIGN).alias("a"), T.keywords_list(F.col("text"), L.STOP_PREDICT).alias("b"),
        T.content_keywords(F.col("text"), L.STOP_FLOW).alias("c"))
    j = lambda c: F.array_join(F.sort_array(c), " ")
    return k.select("doc_id", F.size("a").alias("set_n"), j("a").alias("set_words"), F.size("b").alias("list_n"),
                    j("b").alias("list_words"), F.size("c").alias("content_n"), j("c").alias("content_words"))


# per word, unlike the Spark side which counts over the whole text
_W = "trim_w"
SYL = ("greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - "
       "CASE WHEN ends_with(w, 'e') AND len(regexp_extract_all(w, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END)")


def syllables_sql(x):
    return (f"coalesce(list_sum(list_transform(list_transform({words(f'lower({x})')}, "
            f"lambda w: regexp_replace(w, '^[^\\p{{L}}]+|[^\\p{{L}}]+$', '', 'g')), lambda w: {SYL})), 0)")


def fk_sql(x):
    w, st = f"len({words(x)})", f"greatest(length({x}) - length(translate({x}, '.!?', '')), 1)"
    return (f"(CASE WHEN {w} = 0 THEN 0.0 ELSE 0.39 * ({w} * 1.0 / {st}) + 11.8 * ({syllables_sql(x)} * 1.0 / {w}) - 15.59 END)")


@register("p10_reading_grade", f"SELECT doc_id, {big(syllables_sql('text'))} AS syllables, {r6(fk_sql('text'))} AS grade FROM documents")
def _p10(s, d):
    return docs(s, d).select("doc_id", T.readability(F.col("text")).alias("r")).select("doc_id", "r.syllables", "r.grade")


# RE2 has no lookaround: the first four-digit run of a group is picked from its digit runs
YEAR_OF = ("list_filter(regexp_extract_all({x}, '[0-9]+'), lambda y: length(y) = 4 AND CAST(y AS INT) BETWEEN 1900 AND 2030)")


def cites_sql(x):
    a = trim("split_part(g, ',', 1)")
    return (f"list_filter(list_transform(regexp_extract_all({x}, '\\(([^)]*)\\)', 1), lambda g: {{'author': {a}, "
            f"'year': CAST({YEAR_OF.format(x='g')}[1] AS INT)}}), "
            f"lambda r: r.year IS NOT NULL AND r.author <> '' AND strlen(r.author) < 50)")


@register("p11_citations", f"""
  SELECT doc_id, r.author AS author, {big('r.year')} AS year FROM (SELECT doc_id, unnest({cites_sql('stext')}) AS r FROM sec_docs)""")
def _p11(s, d):
    return section_documents(s, d).select("doc_id", F.inline(T.citations(F.col("text"))))


def numbers_sql(x):
    """list of struct(value, context)"""
    v = "regexp_replace(w, '^[^0-9.,%£$/\\-–]+|[^0-9.,%£$/\\-–]+$', '', 'g')"
    unit = "(contains(r.v, '%') OR contains(r.v, '£') OR contains(r.v, '$'))"
    num = "regexp_replace(r.v, '[^0-9.]', '', 'g')"
    keep = (f"regexp_matches(r.v, '[0-9]') AND strlen(r.v) >= 2 AND NOT (regexp_matches({num}, '^(19|20)[0-9][0-9]$') AND NOT {unit}) "
            f"AND NOT regexp_matches(r.v, '^[0-9]*[/–-][0-9]*$') AND NOT (coalesce(try_cast({num} AS DOUBLE) < 10, false) AND NOT {unit})")
    return f"list_filter(list_transform({words(x)}, lambda w, i: {{'i': i, 'v': {v}}}), lambda r: {keep})"


UNIT_SQL = ("CASE WHEN contains(v, '%') THEN 'percent' WHEN contains(v, '£') OR contains(v, '$') OR contains(v, '€') THEN 'currency' "
            "WHEN contains(v, '-') AND strlen(v) < 8 THEN 'range' ELSE 'plain' END")


@register("p12_significant_numbers", f"""
  SELECT doc_id, v AS value, array_to_string(ws[greatest(i - 5, 1):i + 5], ' ') AS context, {UNIT_SQL} AS unit
  FROM (SELECT doc_id, r.v AS v, r.i AS i, ws FROM (SELECT doc_id, {words('stext')} AS ws, unnest({numbers_sql('stext')}) AS r FROM sec_docs))""")
def _p12(s, d):
    return section_documents(s, d).select("doc_id", F.inline(T.significant_numbers(F.col("text")))).withColumn(
        "unit", T.number_unit(F.col("value")))


NUMERIC = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$"


def signal_sql(wc, ev, sp):
    dens = lambda n: f"(CASE WHEN {wc} > 0 THEN least({n} / ({wc} / 100.0), 1.0) ELSE 0.0 END)"
    return f"(least({wc} / 500.0, 1.0) * 0.3 + {dens(ev)} * 0.4 + {dens(sp)} * 0.3)"


def quality_sql(x):
    sp = f"len(list_filter({words(x)}, lambda w: contains(w, '%') OR regexp_matches(w, '{NUMERIC}')))"
    return f"len({words(x)})", occ_total(f"lower({x})", L.EVIDENCE_WORDS), sp


_wc, _ev, _sp = quality_sql("text")


@register("p14_text_quality", f"""
  SELECT doc_id, {big('wc')} AS words, {big('ev')} AS evidence_words, {big('sp')} AS specific, {r6(signal_sql('wc', 'ev', 'sp'))} AS quality
  FROM (SELECT doc_id, {_wc} AS wc, {_ev} AS ev, {_sp} AS sp FROM marked)""")
def _p14(s, d):
    m = marked_documents(s, d).select(
        "doc_id", T.word_count(F.col("text")).alias("words"), T.occurrences_total(F.lower(F.col("text")), L.EVIDENCE_WORDS).alias("evidence_words"),
        T.specificity_markers(F.col("text")).alias("specific"))
    return m.withColumn("quality", T.quality_signal(F.col("words"), F.col("evidence_words"), F.col("specific")))


# --- X: extraction -------------------------------------------------------------
def items_cte(src, keys, x):
    """CTE bodies: raw items in rule order, then greedy de-duplication per text."""
    stat = f"regexp_matches(s, '[0-9]') AND ({any_of('s', L.STATISTIC_UNITS)} OR {any_of('lower(s)', L.STATISTIC_WORDS)})"
    rules = [("statistic", 2, stat)] + [
        (k, n, any_of("lower(s)", m)) for k, n, m in (
            ("claim", 3, L.CLAIM_MARKERS), ("prediction", 4, L.PREDICTION_MARKERS), ("commitment", 5, L.COMMITMENT_MARKERS))]
    sents = f"(SELECT {keys}, {x} AS body, unnest(l) AS s, generate_subscripts(l, 1) AS n FROM (SELECT *, {sents_dot(x, 15)} AS l FROM {src}))"
    parts = [
        f"SELECT {keys}, '{k}' AS item_type, {o} AS rule_no, n, s AS text, strpos(body, s) - 1 AS start, {L.CONFIDENCE[k]} AS confidence FROM {sents} WHERE {cond}"
        for k, o, cond in rules]
    cite = (f"SELECT {keys}, 'citation' AS item_type, 1 AS rule_no, n, '(' || g || ')' AS text, "
            f"CAST(list_sum(list_transform(ps[:n], lambda p: length(p))) AS BIGINT) - length(g) - 2 AS start, 0.95 AS confidence FROM "
            f"(SELECT {keys}, ps, unnest(gs) AS g, generate_subscripts(gs, 1) AS n FROM (SELECT {keys}, "
            f"regexp_extract_all({x}, '\\(([^)]*)\\)', 1) AS gs, regexp_extract_all({x}, '(?s)[^(]*\\([^)]*\\)') AS ps FROM {src})) "
            f"WHERE len({YEAR_OF.format(x='g')}) > 0 AND strlen(g) < 60")
    return "\nUNION ALL\n".join([cite] + parts)


def greedy_cte(raw, keys):
    """Greedy keep over the ordered list of each key."""
    j = jac("k.w", "x.w")
    return f"""
      SELECT {keys}, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {j} > 0.7)) > 0 THEN acc
                                        ELSE list_append(acc, x) END, l[1:0])) AS it
      FROM (SELECT {keys}, list({{'item_type': item_type, 'text': text, 'start': start, 'confidence': CAST(confidence AS DOUBLE), 'rule_no': rule_no, 'n': n,
                    'w': list_distinct({words('text')})}} ORDER BY confidence DESC, rule_no, n) AS l FROM {raw} GROUP BY {keys})"""


CTE["raw_items"] = items_cte("marked", "doc_id", "text")
CTE["kept_items"] = greedy_cte("raw_items", "doc_id")
CTE["sraw_items"] = items_cte("secs", "doc_id, section_no", "text")
CTE["skept_items"] = greedy_cte("sraw_items", "doc_id, section_no")
CTE["sitems"] = """
  SELECT doc_id, section_no, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY it.confidence DESC, it.rule_no, it.n) - 1 AS item_no,
         it.item_type AS item_type, it.text AS text, it.start AS start, it.confidence AS confidence FROM skept_items"""


def _raw_rows(s, d, items):
    return marked_documents(s, d).select("doc_id", F.inline(items)).select(
        "doc_id", "item_type", "text", "start", "end", "confidence")


def _raw_sql(kind):
    return (f"SELECT doc_id, item_type, text, {big('start')} AS start, {big('start + length(text)')} AS \"end\", {r6('confidence')} AS confidence "
            f"FROM raw_items WHERE item_type = '{kind}'")


@register("x1_citation_items", _raw_sql("citation"))
def _x1(s, d):
    return _raw_rows(s, d, extraction.citation_items(F.col("text")))


for _n, _k in ((2, "statistic"), (3, "claim"), (4, "prediction"), (5, "commitment")):
    register(f"x{_n}_{_k}_items", _raw_sql(_k))(
        lambda s, d, k=_k: _raw_rows(s, d, extraction.sentence_items(F.col("text"), k)))


@register("x6_x7_items", f"""
  SELECT doc_id, it.item_type AS item_type, it.text AS text, {big('it.start')} AS start, {big('it.start + length(it.text)')} AS "end",
         {r6('it.confidence')} AS confidence FROM kept_items""")
def _x6(s, d):
    return _raw_rows(s, d, extraction.extract(F.col("text")))


@register("x8_word_jaccard", f"""
  SELECT doc_id, item_id, {r6(jac('a', 'b'))} AS jaccard, {r6(jac('a3', 'b3'))} AS jaccard_long FROM (
    SELECT d.doc_id, b.item_id, list_distinct({words('d.text')}) AS a, list_distinct({words('b.text')}) AS b,
           list_distinct(list_filter({words('d.text')}, lambda w: strlen(w) > 2)) AS a3,
           list_distinct(list_filter({words('b.text')}, lambda w: strlen(w) > 2)) AS b3
    FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))""")
def _x8(s, d):
    b = table(s, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    j = docs(s, d).withColumn("item_id", F.col("doc_id") % b.agg(F.count("*")).scalar()).join(b, "item_id")
    return j.select("doc_id", "item_id", T.word_jaccard(F.col("text"), F.col("passage")).alias("jaccard"),
                    T.word_jaccard(F.col("text"), F.col("passage"), 2).alias("jaccard_long"))


# second source: the first and the last sentence of each text, confidence 0.42
_SECOND = f"list_filter([{sents_dot('text', 15)}[1], {sents_dot('text', 15)}[-1]], lambda x: x IS NOT NULL)"
CTE["merge_in"] = f"""
  SELECT m.doc_id, coalesce(r.l, []) AS l, {_SECOND} AS o FROM marked m LEFT JOIN
    (SELECT doc_id, list({{'text': it.text, 'method': 'rule', 'confidence': it.confidence, 'w': it.w}}
                         ORDER BY it.confidence DESC, it.rule_no, it.n) AS l FROM kept_items GROUP BY doc_id) r USING (doc_id)"""
_first_hit = "list_position(list_transform(acc, lambda k: {j} > 0.6), true)".format(j=jac("k.w", "x.w"))
CTE["merged"] = f"""
  SELECT doc_id, unnest(list_reduce(list_transform(o, lambda t: {{'text': t, 'method': 'model', 'confidence': CAST(0.42 AS DOUBLE), 'w': list_distinct({words('t')})}}),
    lambda acc, x: CASE WHEN coalesce({_first_hit}, 0) > 0 THEN list_transform(acc, lambda k, i: CASE WHEN i = {_first_hit}
        THEN {{'text': k.text, 'method': 'hybrid', 'confidence': least(k.confidence + x.confidence, 1.0) * 0.9, 'w': k.w}} ELSE k END)
      ELSE list_append(acc, x) END, l)) AS it FROM merge_in"""


@register("x9_merged_items", f"SELECT doc_id, it.text AS text, it.method AS method, {r6('it.confidence')} AS confidence FROM merged")
def _x9(s, d):
    sents = T.sentences_dot(F.col("text"), 15)
    m = marked_documents(s, d).select(
        "doc_id", extraction.extract(F.col("text")).alias("items"),
        F.array_compact(F.array(F.get(sents, F.lit(0)), F.get(F.reverse(sents), F.lit(0)))).alias("other"))
    none = F.lit(None).cast("int")
    other = F.transform("other", lambda t: F.struct(
        F.lit("claim").alias("item_type"), t.alias("text"), none.alias("start"), none.alias("end"), F.lit("model").alias("method"),
        F.lit(0.42).alias("confidence")))
    return m.select("doc_id", F.inline(extraction.merge_items(F.col("items"), other))).select("doc_id", "text", "method", "confidence")


@register("x10_claims_evidence", f"""
  SELECT doc_id, {big('section_no')} AS section_no, {big('item_no')} AS item_no, CASE WHEN c THEN 'claim' ELSE 'evidence' END AS role, text,
         CASE WHEN c THEN {r6('confidence')} END AS specificity, CASE WHEN c THEN item_type IN ('prediction', 'commitment') END AS verifiable,
         CASE WHEN NOT c THEN 'rule-extracted' END AS source, CASE WHEN NOT c THEN item_type END AS evidence_type,
         CASE WHEN NOT c THEN item_type = 'statistic' END AS quantified
  FROM (SELECT *, item_type IN ('claim', 'argument', 'prediction', 'commitment') AS c FROM sitems)""")
def _x10(s, d):
    return extraction.claims_and_evidence(extraction.item_rows(extraction.with_items(sections.sectioned(section_documents(s, d)))))


_fb_claim, _fb_q = any_of("low", L.FALLBACK_CLAIMS), any_of("low", L.FALLBACK_QUANTIFIED)
_fb_ev = (f"((contains(t, '(') AND contains(t, ')') AND {any_of('low', L.FALLBACK_PAREN_EVIDENCE)}) OR {any_of('low', L.FALLBACK_EVIDENCE)})")
CTE["fallback"] = f"""
  SELECT doc_id, t, {_fb_claim} AS c, {_fb_ev} AS e, {_fb_q} AS qn,
         CASE WHEN contains(t, '%') OR contains(t, '£') THEN 0.9 WHEN strlen(t) > 80 THEN 0.7 ELSE 0.5 END AS spec,
         CASE WHEN regexp_matches(t, '^[^(]*\\(([^)]*)\\)') THEN regexp_extract(t, '^[^(]*\\(([^)]*)\\)', 1) ELSE 'inline data' END AS src
  FROM (SELECT doc_id, s AS t, lower(s) AS low FROM (SELECT doc_id, unnest({sents_dot('text', 15)}) AS s FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM plain_kept)))"""
CTE["plain_raw"] = items_cte("documents", "doc_id", "text")
CTE["plain_kept"] = "SELECT DISTINCT doc_id FROM plain_raw"

@register("x12_fallback", f"""
  SELECT doc_id, 'claim' AS role, t AS text, {r6('spec')} AS specificity, e AS verifiable, NULL AS source, NULL AS evidence_type,
         CAST(NULL AS BOOLEAN) AS quantified FROM fallback WHERE c
  UNION ALL SELECT doc_id, 'evidence', t, NULL, NULL, src, CASE WHEN qn THEN 'statistical' ELSE 'citation' END, qn FROM fallback WHERE e""")
def _x12(s, d):
    found = extraction.all_items(F.col("text"))
    return docs(s, d).where(F.size(found) == 0).select("doc_id", F.inline(extraction.fallback_items(F.col("text"))))


INTENT = "coalesce(o_orderpriority, '') || ' ' || CASE o_orderkey % 11 " + " ".join(
    f"WHEN {i} THEN {q(x)}" for i, x in enumerate([
        "mark this essay", "score the tender bid", "policy impact assessment", "survey methodology review", "contract legal terms",
        "NHS clinical governance", "GCSE English language grade", "research study strategy", "green book regulation", "language proficiency",
    ])) + " ELSE 'general review' END"


def route_sql(x, routes, default):
    return "CASE " + " ".join(f"WHEN {any_of(f'lower({x})', k)} THEN {q(t)}" for t, k in routes) + f" ELSE {q(default)} END"


@register("x13_intent_routes", f"""
  SELECT o_orderkey, {route_sql('i', L.DOMAIN_ROUTES, 'generic')} AS domain, {route_sql('i', L.FRAMEWORK_ROUTES, 'generic_quality')} AS framework,
         {route_sql('i', L.GENRE_ROUTES, 'essay')} AS genre,
         CASE {route_sql('i', L.DOMAIN_ROUTES, 'generic')} WHEN 'academic' THEN 'academic' WHEN 'tender' THEN 'tender' ELSE 'generic' END AS toolset,
         array_to_string(list_filter([{', '.join(f"CASE WHEN {any_of('lower(i)', k)} THEN {q(t)} END" for t, k in L.SECTOR_ROUTES)}],
                                     lambda x: x IS NOT NULL), '|') AS sectors
  FROM (SELECT o_orderkey, {INTENT} AS i FROM orders)""")
def _x13(s, d):
    i = table(s, d, "orders").select("o_orderkey", F.expr(INTENT).alias("i"))
    return adaptive.intent_routes(i, "i").drop("i").withColumn("sectors", F.array_join("sectors", "|"))


# --- adaptive extraction -------------------------------------------------------
def _adaptive_cte(genre, src="secs_text"):
    sent = (f"(SELECT doc_id, n, s, lower(s) AS low FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS n "
            f"FROM (SELECT doc_id, {sents_space('text')} AS l FROM {src})))")
    rules = {
        "essay": [("counter_arguments", any_of("low", L.ESSAY_COUNTER), "0.7", 0.8),
                  ("vocabulary_sophistication", any_of("low", L.ESSAY_VOCABULARY),
                   "least(0.3 * (" + " + ".join(f"CAST(contains(low, {q(m)}) AS INT)" for m in L.ESSAY_VOCABULARY) + "), 1.0)", 0.7),
                  ("sentence_variety", any_of("low", L.ESSAY_SUBORDINATE) + " AND strlen(s) > 30", "0.6", 0.6),
                  ("cohesion_devices", starts_any("low", L.ESSAY_COHESION_STARTS), "0.6", 0.7),
                  ("personal_voice", any_of("low", L.ESSAY_VOICE), "0.5", 0.6),
                  ("rhetorical_devices", "ends_with(s, '?')", "0.6", 0.7)],
        "tender": [("claims", any_of("low", L.TENDER_CLAIMS), "0.6", 0.8), ("case_studies", any_of("low", L.TENDER_CASES), "0.7", 0.9),
                   ("named_staff", f"({any_of('s', L.TENDER_STAFF_TITLES)} OR (contains(s, '(') AND regexp_matches(s, '^\\p{{Lu}}')))", "0.7", 0.8),
                   ("compliance_refs", any_of("low", L.TENDER_COMPLIANCE), "0.7", 0.9),
                   ("quantified_outcomes", "regexp_matches(s, '[0-9]') AND " + any_of("low", L.TENDER_OUTCOMES), "0.8", 0.9)],
        "policy": [("objectives", any_of("low", L.POLICY_OBJECTIVES), "0.7", 0.9), ("predictions", any_of("low", L.POLICY_PREDICTIONS), "0.6", 0.8),
                   ("evidence_base", any_of("low", L.POLICY_EVIDENCE), "0.7", 0.8),
                   ("stakeholder_coverage", any_of("low", L.POLICY_STAKEHOLDERS), "0.6", 0.7),
                   ("implementation", any_of("low", L.POLICY_IMPLEMENTATION), "0.6", 0.8)],
        "contract": [("obligations", any_of("low", L.CONTRACT_OBLIGATIONS), "0.8", 0.9), ("conditions", any_of("low", L.CONTRACT_CONDITIONS), "0.7", 0.8),
                     ("definitions", f"({any_of('low', L.CONTRACT_DEFINITIONS)} OR (contains(s, '\"') AND contains(low, 'means')))", "0.7", 0.7),
                     ("risk_clauses", any_of("low", L.CONTRACT_RISKS), "0.8", 0.9)]}[genre]
    parts = [f"SELECT doc_id, '{c}' AS category, s AS text, CAST({ql} AS DOUBLE) AS quality, CAST({rel} AS DOUBLE) AS relevance FROM {sent} WHERE {cond}"
             for c, cond, ql, rel in rules]
    if genre == "essay":
        first = f"list_filter({sents_space('text')}, lambda s: strlen(s) > 20)[1]"
        paras = f"list_transform({PARAS}, lambda p: {sents_space('p')}[1])"
        clean = f"regexp_replace(lower(w), '[^\\p{{L}}]+', '', 'g')"
        parts = [f"SELECT doc_id, 'argument_thesis' AS category, {first} AS text, CAST(0.6 AS DOUBLE) AS quality, CAST(0.9 AS DOUBLE) AS relevance FROM {src} WHERE {first} IS NOT NULL",
                 f"SELECT doc_id, 'topic_sentences', s, 0.5, 0.7 FROM (SELECT doc_id, unnest({paras}) AS s FROM {src}) WHERE strlen(s) > 10",
                 *parts,
                 f"SELECT doc_id, 'rhetorical_devices', 'Repetition: \"' || w || '\" appears ' || count(*) || ' times', 0.4, 0.5 FROM "
                 f"(SELECT doc_id, {clean} AS w FROM (SELECT doc_id, unnest({words('text')}) AS w FROM {src} WHERE len({words('text')}) >= 10)) "
                 f"WHERE strlen(w) > 4 GROUP BY doc_id, w HAVING count(*) >= 3"]
    return "\nUNION ALL\n".join(parts)


CTE["secs_text"] = "SELECT doc_id, stext AS text FROM sec_docs"
for _g in L.CATEGORIES:
    CTE[f"ad_{_g}"] = _adaptive_cte(_g)


def _adaptive(genre):
    return lambda s, d: section_documents(s, d).select("doc_id", F.inline(adaptive.items(F.col("text"), genre)))


for _n, _g in ((14, "essay"), (15, "tender"), (16, "policy"), (17, "contract")):
    register(f"x{_n}_adaptive_{_g}", f"SELECT doc_id, category, text, {r6('quality')} AS quality, {r6('relevance')} AS relevance FROM ad_{_g}")(_adaptive(_g))


@register("x18_repetition", f"""
  SELECT doc_id, w AS word, {big('count(*)')} AS n FROM (SELECT doc_id, regexp_replace(lower(w), '[^\\p{{L}}]+', '', 'g') AS w FROM
    (SELECT doc_id, unnest({words('text')}) AS w FROM documents WHERE len({words('text')}) >= 10))
  WHERE strlen(w) > 4 GROUP BY doc_id, w HAVING count(*) >= 3""")
def _x18(s, d):
    return docs(s, d).select("doc_id", F.inline(T.repeated_words(F.col("text"))))


@register("x19_category_summary", f"""
  SELECT d.doc_id, c.category, {big('count(a.category)')} AS n, max(a.quality) AS best_quality, {r6('max(m.mean_quality)')} AS mean_quality
  FROM documents d CROSS JOIN (SELECT unnest({sql_list([c for c, _, _ in L.CATEGORIES['policy']])}) AS category) c
  LEFT JOIN ad_policy a ON a.doc_id = d.doc_id AND a.category = c.category
  LEFT JOIN (SELECT doc_id, avg(quality) AS mean_quality FROM ad_policy GROUP BY doc_id) m ON m.doc_id = d.doc_id GROUP BY d.doc_id, c.category""")
def _x19(s, d):
    return adaptive.category_summary(
        section_documents(s, d).select("doc_id", adaptive.items(F.col("text"), "policy").alias("items")), "policy").drop("best_example")


@register("x20_pipeline_types", f"""
  SELECT doc_id, category, role, {r6('specificity')} AS specificity, verifiable, evidence_type, quantified, {big('count(*)')} AS n FROM (
    SELECT doc_id, category, CASE WHEN category IN ('argument_thesis', 'claims', 'objectives', 'obligations', 'topic_sentences', 'personal_voice')
             THEN 'claim' ELSE 'evidence' END AS role,
           CASE WHEN category IN ('argument_thesis', 'claims', 'objectives', 'obligations', 'topic_sentences', 'personal_voice') THEN quality END AS specificity,
           CASE WHEN category IN ('argument_thesis', 'claims', 'objectives', 'obligations') THEN quality > 0.5
                WHEN category IN ('topic_sentences', 'personal_voice') THEN false END AS verifiable,
           CASE WHEN category IN ('argument_thesis', 'claims', 'objectives', 'obligations', 'topic_sentences', 'personal_voice') THEN NULL
                WHEN category = 'case_studies' THEN 'case_study' WHEN category = 'quantified_outcomes' THEN 'statistic'
                WHEN category IN ('evidence_base', 'compliance_refs', 'definitions') THEN 'citation' ELSE 'primary_data' END AS evidence_type,
           CASE WHEN category IN ('argument_thesis', 'claims', 'objectives', 'obligations', 'topic_sentences', 'personal_voice') THEN NULL
                ELSE category = 'quantified_outcomes' END AS quantified
    FROM (SELECT * FROM ad_essay UNION ALL SELECT * FROM ad_tender UNION ALL SELECT * FROM ad_policy UNION ALL SELECT * FROM ad_contract)) GROUP BY ALL""")
def _x20(s, d):
    every = section_documents(s, d).select(
        "doc_id", F.inline(adaptive.items(F.col("text"), *L.CATEGORIES)))
    return adaptive.pipeline_types(every).groupBy(
        "doc_id", "category", "role", "specificity", "verifiable", "evidence_type", "quantified").agg(F.count("*").alias("n"))


# a model reply wrapping the JSON array of scores in prose
REPLY = ("'Scores follow: [' || '{\"id\": \"e' || event_id || '\", \"score\": ' || (event_id % 10) || '.5}, {\"id\": \"x' || event_id || '\", \"score\": 2}' "
         "|| CASE WHEN event_id % 5 = 0 THEN ' oops' ELSE '' END || '] as asked'")


@register("x21_parse_scores", f"""
  SELECT event_id, 'e' || event_id AS id, {r6("event_id % 10 + 0.5")} AS score FROM events WHERE event_id % 5 <> 0
  UNION ALL SELECT event_id, 'x' || event_id, {r6('2')} FROM events WHERE event_id % 5 <> 0""")
def _x21(s, d):
    return table(s, d, "events").select("event_id", F.inline(adaptive.parse_scores(F.expr(REPLY))))
