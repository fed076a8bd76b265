"""Queries over quality checks (V), predictions (R) and the deterministic score (B8)."""

from pyspark.sql import functions as F

from plumbline.catalog.base import (
    CTE, any_of, big, clip, jac, marked_documents, occ_total, q, r6, register, section_documents, sents_dot, sql_list, table, trim, words)
from plumbline.catalog.graph_queries import STRUCT
from plumbline.catalog.text_queries import (
    PARAS, YEAR_OF, cites_sql, fk_sql, kw_content, kw_list, numbers_sql, sents_ws, UNIT_SQL)
from plumbline.functions import lexicons as L
from plumbline.functions.text import WS_CLASS
from plumbline.operators import checks as V, extraction, graph, predictions as R, sections
from plumbline.plans.document_gate import document_graph
from plumbline.session import settle

DOCS = lambda s, d: sections.sectioned(section_documents(s, d))
CTE["vsec"] = f"SELECT *, lower(text) AS low, lower(title) AS lt, {cites_sql('text')} AS cites FROM secs_wc"
CTE["vdoc"] = "SELECT doc_id, any_value(doc_type) AS doc_type, sum(word_count) AS total, count(*) AS n, min(word_count) AS lo, max(word_count) AS hi FROM vsec GROUP BY doc_id"


def row(check, sev, effect, title, value="NULL", sec="NULL", src="vsec", where="true"):
    t = title if title.startswith("(") else q(title)
    return (f"SELECT doc_id, '{check}' AS \"check\", '{sev}' AS severity, {big(sec)} AS section_no, {t} AS title, "
            f"{r6(value)} AS value, {effect}::DOUBLE AS effect FROM {src} WHERE {where}")


def case(table_, default, x="doc_type"):
    return "CASE " + " ".join(f"WHEN {x} IN ({', '.join(map(q, k))}) THEN {v}" for k, v in table_) + f" ELSE {default} END"


SQLV = {}
_c = "(SELECT doc_id, section_no, r.author || ' (' || r.year || ')' AS who, 2026 - r.year AS age FROM (SELECT doc_id, section_no, unnest(cites) AS r FROM vsec))"
SQLV["citations"] = [
    row("citation_format", "warning", -0.05, "no citations", "word_count", "section_no", where="len(cites) = 0 AND word_count > 100"),
    row("citation_recency", "warning", -0.05, "('outdated source: ' || who)", "greatest(age, 0)", "section_no", _c, "age > 10"),
    row("citation_recency", "info", 0.1, "('recent source: ' || who)", "greatest(age, 0)", "section_no", _c, "age <= 3")]
SQLV["word_count"] = [
    row("word_count", "warning", -0.05, "document may be too short", "total", src="vdoc", where=f"total < {case(L.WORD_MINIMUM, 100)}"),
    row("word_count", "info", -0.05, "unbalanced section lengths", "hi * 1.0 / nullif(lo, 0)", src="vdoc", where="n >= 2 AND lo > 0 AND hi > lo * 5")]
_has = lambda ws: f"EXISTS (SELECT 1 FROM vsec s WHERE s.doc_id = vdoc.doc_id AND {any_of('s.lt', ws)})"
SQLV["structure"] = [
    row("structure", "warning", -0.05, f"missing section: {k}", src="vdoc", where=f"doc_type IN ({', '.join(map(q, t))}) AND NOT {_has([k])}")
    for t, ks in L.EXPECTED_SECTIONS for k in ks] + [
    row("structure", "info", 0.1, "has introduction and conclusion", src="vdoc", where=f"{_has(L.INTRO_TITLES)} AND {_has(L.CONCLUSION_TITLES)}")]
CTE["vread"] = f"""SELECT doc_id, {fk_sql('txt')} AS fk, {case([(k, a) for k, a, _ in L.READING_RANGE], 8.0)} AS lo, {case([(k, b) for k, _, b in L.READING_RANGE], 18.0)} AS hi
  FROM (SELECT doc_id, any_value(doc_type) AS doc_type, sum(word_count) AS total, string_agg(text, ' ' ORDER BY section_no) AS txt FROM vsec GROUP BY doc_id) WHERE total >= 50"""
SQLV["reading_level"] = [
    row("reading_level", "info", -0.05, "reading level may be too simple", "fk", src="vread", where="fk < lo"),
    row("reading_level", "info", 0, "reading level is very high", "fk", src="vread", where="fk > hi"),
    row("reading_level", "info", 0.05, "reading level appropriate", "fk", src="vread", where="fk BETWEEN lo AND hi")]
_key = f"substring(lower(regexp_replace(p, '[^\\p{{L}}\\p{{N}}{WS_CLASS}]', '', 'g')), 1, 60)"
CTE["vpara"] = f"""SELECT doc_id, section_no, n, {_key} AS key FROM (SELECT doc_id, section_no, unnest(l) AS p, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, section_no, {PARAS} AS l FROM vsec)) WHERE strlen(p) > 80"""
CTE["vdup"] = "SELECT *, first_value(section_no) OVER (PARTITION BY doc_id, key ORDER BY section_no, n) AS f FROM vpara"
SQLV["duplicates"] = [row("duplicate_content", "warning", -0.05, "duplicate paragraph", "NULL", "section_no", "vdup", "f <> section_no")]
_num = f"len(list_filter(regexp_extract_all(text, '\\[([^\\]]*)\\]', 1), lambda g: regexp_matches({trim('g')}, '^\\+?[0-9]{{1,9}}$')))"
_foot = (f"length(text) - length(translate(text, {q(L.FOOTNOTE_MARKS)}, '')) + len(list_filter({words('text')}, lambda w: regexp_matches(w, '^\\^\\+?[0-9]{{1,9}}$')))")
CTE["vref"] = f"""SELECT *, CAST(h > 0 AS INT) + CAST(nu > 0 AS INT) + CAST(f > 0 AS INT) AS styles FROM
  (SELECT doc_id, sum(len(cites)) AS h, sum({_num}) AS nu, sum({_foot}) AS f FROM vsec GROUP BY doc_id)"""
SQLV["reference_style"] = [
    row("reference_style", "warning", -0.05, "mixed citation styles", "styles", src="vref", where="styles > 1"),
    row("reference_style", "info", 0.05, "('consistent style: ' || CASE WHEN h > 0 THEN 'author-year' WHEN nu > 0 THEN 'numeric' ELSE 'footnote' END)", "h + nu + f",
        src="vref", where="styles = 1 AND h + nu + f >= 3")]
SQLV["fallacies"] = [row("logical_fallacy", "warning", -0.15, f"{n}: {m}", "NULL", "section_no", where=f"contains(low, {q(m)})") for n, ms in L.FALLACIES for m in ms]
CTE["vhedge"] = f"SELECT doc_id, section_no, {occ_total('low', L.HEDGES)} * 100.0 / word_count AS h, {occ_total('low', L.STRONG_ASSERTIONS)} * 100.0 / word_count AS s FROM vsec WHERE word_count >= 30"
SQLV["hedging"] = [
    row("hedging", "warning", -0.1, "over-hedged section", "h", "section_no", "vhedge", "h > 8"),
    row("hedging", "warning", -0.1, "under-hedged section", "s", "section_no", "vhedge", "h < 1 AND s > 3"),
    row("hedging", "info", 0.05, "well-balanced hedging", "h", "section_no", "vhedge", "h BETWEEN 3 AND 8")]
_tw = lambda x: f"list_distinct(list_filter(list_transform({words(f'lower({x})')}, lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')), lambda w: strlen(w) > 3))"
CTE["vtopic"] = f"""SELECT doc_id, section_no, len(ss) AS n, CASE WHEN len(ss) >= 4 AND len({_tw('ss[1]')}) > 0 THEN
    len(list_filter(ss[2:], lambda s: list_has_any({_tw('ss[1]')}, {_tw('s')}))) * 1.0 / (len(ss) - 1) END AS share
  FROM (SELECT doc_id, section_no, {sents_ws('p')} AS ss FROM (SELECT doc_id, section_no, unnest({PARAS}) AS p FROM vsec))"""
SQLV["topic_sentences"] = [
    row("topic_sentence", "info", -0.05, "long paragraph", "n", "section_no", "vtopic", "n > 10"),
    row("topic_sentence", "info", -0.05, "weak topic sentence", "share * 100", "section_no", "vtopic", "share < 0.3")]
CTE["vctr"] = f"""SELECT s.doc_id, s.section_no, s.word_count, d.total, {occ_total('low', L.COUNTER_MARKERS)} AS c, word_count >= 200 AS long FROM vsec s JOIN vdoc d ON d.doc_id = s.doc_id
  WHERE d.doc_type NOT IN ('contract', 'legal') AND d.total >= 500"""
CTE["vctrd"] = "SELECT doc_id, max(total) AS total, coalesce(sum(c) FILTER (long), 0) AS c FROM vctr GROUP BY doc_id"
SQLV["counter_arguments"] = [
    row("counter_argument", "info", -0.05, "no counter-argument engagement", "word_count", "section_no", "vctr", "long AND c = 0"),
    row("counter_argument", "warning", -0.15, "no counter-arguments in document", "total", src="vctrd", where="c = 0"),
    row("counter_argument", "info", 0.1, "good counter-argument engagement", "c", src="vctrd", where="c >= 3")]
CTE["vtrans"] = f"SELECT doc_id, section_no, {any_of(f'lower(coalesce({sents_ws('text')}[1], chr(0)))', L.TRANSITIONS)} AS smooth FROM vsec WHERE section_no > 1"
CTE["vtransd"] = "SELECT doc_id, count(*) AS n, bool_and(smooth) AS every FROM vtrans GROUP BY doc_id"
SQLV["transitions"] = [
    row("transition", "info", -0.03, "abrupt transition", "NULL", "section_no", "vtrans", "NOT smooth"),
    row("transition", "info", 0.05, "all section transitions are smooth", "n", src="vtransd", where="every AND n >= 2")]
# no lookaround in RE2: double every separator, then count matches with both neighbours
_vague = " + ".join(f"len(regexp_extract_all(padded, '[^0-9A-Za-z]{m.replace(' ', '  ')}[^0-9A-Za-z]'))" for m in L.VAGUE_TERMS)
CTE["vspec"] = f"""SELECT doc_id, section_no, word_count, ({_vague}) * 100.0 / word_count AS v FROM
  (SELECT doc_id, section_no, word_count, ' ' || regexp_replace(low, '([^0-9A-Za-z])', '\\1\\1', 'g') || ' ' AS padded FROM vsec WHERE word_count >= 20)"""
SQLV["specificity"] = [
    row("specificity", "warning", -0.1, "high vagueness density", "v", "section_no", "vspec", "v > 5"),
    row("specificity", "info", 0.05, "specific language", "v", "section_no", "vspec", "v < 1 AND word_count >= 50")]
_kw = kw_content("text", L.STOP_FLOW)
CTE["vkw"] = f"SELECT s.doc_id, s.section_no, d.n, {_kw} AS k FROM vsec s JOIN vdoc d ON d.doc_id = s.doc_id WHERE d.n >= 3"
CTE["vflow"] = """SELECT doc_id, n, len(list_intersect(i, b)) * 1.0 / len(i) AS ib, len(list_intersect(i, c)) * 1.0 / len(i) AS ic,
    len(list_filter(c, lambda w: NOT list_contains(i, w) AND NOT list_contains(b, w))) * 1.0 / len(c) AS nw FROM
  (SELECT doc_id, max(n) AS n, any_value(k) FILTER (section_no = 1) AS i, any_value(k) FILTER (section_no = n) AS c,
          list_distinct(flatten(coalesce(list(k) FILTER (section_no > 1 AND section_no < n), []))) AS b FROM vkw GROUP BY doc_id) WHERE len(i) > 0 AND len(c) > 0"""
SQLV["argument_flow"] = [
    row("argument_flow", "warning", -0.1, "weak intro-to-body connection", "ib * 100", src="vflow", where="ib < 0.2"),
    row("argument_flow", "warning", -0.1, "weak intro-to-conclusion connection", "ic * 100", src="vflow", where="ic < 0.2"),
    row("argument_flow", "warning", -0.1, "conclusion introduces new concepts", "nw * 100", "n", "vflow", "nw > 0.5"),
    row("argument_flow", "info", 0.1, "strong argument flow", src="vflow", where="ib >= 0.4 AND ic >= 0.4 AND nw <= 0.3")]
_ids = {"citations": 1, "word_count": 2, "structure": 4, "reading_level": 5, "duplicates": 6, "reference_style": 8, "fallacies": 9, "hedging": 10,
        "topic_sentences": 11, "counter_arguments": 12, "transitions": 13, "specificity": 14, "argument_flow": 15}
for _name, _parts in SQLV.items():
    register(f"v{_ids[_name]}_{_name}", " UNION ALL ".join(_parts))(lambda s, d, n=_name: V.signals(DOCS(s, d), [n]))

CTE["vnum"] = f"""SELECT doc_id, v, list(DISTINCT section_no) AS secs_in, any_value({UNIT_SQL}) AS unit, any_value(try_cast(regexp_replace(v, '[^0-9.]', '', 'g') AS DOUBLE)) AS x FROM
  (SELECT doc_id, section_no, r.v AS v FROM (SELECT doc_id, section_no, unnest({numbers_sql('text')}) AS r FROM vsec)) GROUP BY doc_id, v"""
SQLV["numbers"] = [f"""SELECT a.doc_id, 'number_consistency' AS "check", 'warning' AS severity, CAST(NULL AS BIGINT) AS section_no,
  'possible inconsistency: ' || least(a.v, b.v) || ' vs ' || greatest(a.v, b.v) AS title, {r6('b.x / a.x')} AS value, -0.05::DOUBLE AS effect
  FROM vnum a JOIN vnum b ON a.doc_id = b.doc_id AND a.unit = b.unit AND a.x >= 10 AND b.x > a.x AND b.x / a.x < 1.15 WHERE NOT list_has_any(a.secs_in, b.secs_in)"""]


@register("v3_number_consistency", SQLV["numbers"][0])
def _v3(s, d):
    return V.number_consistency(DOCS(s, d))


CTE["vev"] = """SELECT doc_id, count(*) FILTER (item_type IN ('claim', 'prediction', 'commitment')) AS c, count(*) FILTER (item_type IN ('statistic', 'citation')) AS e,
  count(*) FILTER (item_type = 'statistic') AS qn FROM sitems GROUP BY doc_id"""
SQLV["evidence"] = [
    row("evidence_quality", "warning", -0.05, "low evidence-to-claim ratio", "e * 1.0 / c", src="vev", where="c > 0 AND e < 0.5 * c"),
    row("evidence_quality", "info", 0.1, "strong evidence-to-claim ratio", "e * 1.0 / c", src="vev", where="c > 0 AND e >= c"),
    row("evidence_quality", "info", 0.1, "evidence is quantified", "qn * 100.0 / e", src="vev", where="e > 0 AND qn * 100.0 / e >= 50")]


def _items(docs):
    return extraction.claims_and_evidence(extraction.item_rows(extraction.with_items(docs)))


@register("v7_evidence_quality", " UNION ALL ".join(SQLV["evidence"]))
def _v7(s, d):
    return V.evidence_signals(_items(DOCS(s, d)))


_core = [p for n in [*V.CORE, "numbers", "evidence"] for p in SQLV[n]]
_all = [p for n in SQLV for p in SQLV[n]]


@register("validate_all", 'SELECT doc_id, "check", severity, count(*) AS n, ' + r6("sum(effect)") + " AS effect FROM (" + " UNION ALL ".join(_all) + ") GROUP BY ALL")
def _validate(s, d):
    docs = settle(DOCS(s, d), "sections")
    return V.validate(docs, _items(docs)).groupBy("doc_id", "check", "severity").agg(F.count("*").alias("n"), F.sum("effect").alias("effect"))


CTE["line_keys"] = f"""SELECT doc_id, substring(lower(regexp_replace(p, '[^\\p{{L}}\\p{{N}}{WS_CLASS}]', '', 'g')), 1, 60) AS key FROM
  (SELECT doc_id, {trim('p')} AS p FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents)) WHERE strlen(p) > 80"""


@register("v6_repeated_lines_across", "SELECT key, count(DISTINCT doc_id) AS documents, count(*) AS paragraphs FROM line_keys GROUP BY key HAVING count(DISTINCT doc_id) > 1")
def _v6b(s, d):
    return V.repeated_lines_across(table(s, d, "documents").select("doc_id", "text"))


CTE["core_effect"] = "SELECT doc_id, sum(effect) AS effect FROM (" + " UNION ALL ".join(_core) + ") GROUP BY doc_id"


@register("b8_deterministic_score", f"""SELECT m.doc_id, {r6(clip(f'{STRUCT} + 0.05 * coalesce(e.effect, 0)', 0, 1))} AS score FROM gp_metrics m LEFT JOIN core_effect e ON e.doc_id = m.doc_id""")
def _b8(s, d):
    m = graph.graph_metrics(document_graph(section_documents(s, d), segmented=True)).select("doc_id", graph.structural_score().alias("structural"))
    docs = settle(DOCS(s, d), "sections")
    return V.deterministic_score(m, V.validate(docs, _items(docs), deep=False))


# --- R: predictions ----------------------------------------------------------------
_past = "(" + " OR ".join(f"list_contains(lw, {q(m)})" for m in L.PAST_MARKERS) + ")"
_dig = "regexp_matches(t, '[0-9]')"
_has = lambda w: any_of("low", w)
_ptype = (f"CASE WHEN {_has(L.TARGET_WORDS)} AND {_dig} AND {_has(L.TARGET_UNITS)} THEN 'quantitative_target' WHEN {_has(L.COST_WORDS)} AND {_has(L.COST_SIZES)} AND {_has(L.COST_PERIODS)} THEN 'cost_estimate' "
          f"WHEN {_has(L.TIMELINE_WORDS)} AND {_has(L.TIMELINE_ACTIONS)} AND strlen(t) > 30 THEN 'timeline' WHEN {_has(L.COMPARISON_WORDS)} AND {_dig} THEN 'comparison_claim' "
          f"WHEN {_has(L.GOAL_WORDS)} AND NOT {_dig} AND strlen(t) > 25 THEN 'qualitative_goal' WHEN {_has(L.PLEDGE_WORDS)} AND strlen(t) > 20 THEN 'commitment' END")
CTE["rsent"] = f"""SELECT doc_id, n, t, lower(t) AS low, regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{N}}]+') AS lw FROM
  (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, {sents_dot('text', 10)} AS l FROM marked))"""
CTE["rtyped"] = f"""SELECT doc_id, n, t, low, k, list_distinct(list_filter({words('low')}, lambda w: strlen(w) > 2)) AS w FROM
  (SELECT *, {_ptype} AS k FROM rsent WHERE NOT ({_past} AND NOT {_has(L.FUTURE_MARKERS)})) WHERE k IS NOT NULL"""
_jk = jac("k.w", "x.w")
CTE["rkept"] = f"""SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS prediction_no FROM (SELECT doc_id, list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k:
    (k.k = x.k AND {_jk} > 0.35) OR {_jk} > 0.8)) > 0 THEN acc ELSE list_append(acc, x) END, l[1:0]) AS l
  FROM (SELECT doc_id, list({{'t': t, 'low': low, 'k': k, 'w': w}} ORDER BY n) AS l FROM rtyped GROUP BY doc_id))"""
_n = "0-9.,%£$"
_tv = (f"CASE WHEN strlen(regexp_extract(t, '^[^{_n}]*([{_n}]+)', 1)) >= 2 THEN regexp_extract(t, '^[^{_n}]*([{_n}]+[MBKm]?)', 1) "
       f"WHEN regexp_extract(t, '^[^{_n}]*[{_n}][^{_n}MBKm]*([MBKm]|[{_n}]+[MBKm]?)', 1) <> '' THEN regexp_extract(t, '^[^{_n}]*([{_n}])', 1) || "
       f"regexp_extract(t, '^[^{_n}]*[{_n}][^{_n}MBKm]*([MBKm]|[{_n}]+[MBKm]?)', 1) END")


def _cutat(x, n):
    return (f"CASE WHEN strpos({x}, '.') > 0 THEN {x}[:strpos({x}, '.') - 1] WHEN strpos({x}, ',') > 0 THEN {x}[:strpos({x}, ',') - 1] ELSE {x}[:{n}] END")


_wi, _by, _mo = "low[strpos(low, 'within'):]", "low[strpos(low, 'by '):]", "strpos(low, 'months')"
_tf = (f"CASE WHEN contains(low, 'within') THEN {_cutat(_wi, 40)} WHEN strpos(low, 'by ') > 0 AND regexp_matches({_by}, '^by \\s*({'|'.join(L.BY_STARTS)})') THEN {_cutat(_by, 30)} "
       f"WHEN {_mo} > 0 THEN {trim(f'substring(low, greatest({_mo} - 10, 1), least({_mo} - 1, 10) + 20)')} END")
CTE["preds"] = f"""SELECT doc_id, prediction_no, t AS text, k AS prediction_type, CASE WHEN k IN ('quantitative_target', 'cost_estimate', 'comparison_claim') THEN {_tv} END AS target_value,
  CASE WHEN k <> 'comparison_claim' THEN {_tf} END AS timeframe FROM (SELECT doc_id, prediction_no, x.t AS t, x.low AS low, x.k AS k FROM rkept)"""
PREDS = lambda s, d: R.prediction_rows(marked_documents(s, d))


@register("r1_r4_predictions", "SELECT * FROM preds")
def _r1(s, d):
    return PREDS(s, d)


CTE["mce"] = "SELECT doc_id, item_no, item_type, text, confidence, item_type IN ('claim', 'prediction', 'commitment') AS c FROM mitems"
_ov = f"(CASE WHEN len(pk) = 0 OR len(ik) = 0 THEN 0 ELSE len(list_filter(pk, lambda w: list_contains(ik, w))) * 1.0 / len(pk) END)"
CTE["rpairs"] = f"""SELECT *, {_ov} AS o FROM (SELECT p.doc_id, p.prediction_no, i.c, i.item_type, i.confidence, {kw_list('p.text', L.STOP_PREDICT)} AS pk, {kw_list('i.text', L.STOP_PREDICT)} AS ik
  FROM preds p JOIN mce i ON i.doc_id = p.doc_id)"""
CTE["rsum"] = """SELECT doc_id, prediction_no, count(*) FILTER (NOT c) AS seen, count(*) FILTER (NOT c AND o > 0.2) AS supporting,
  sum(CASE WHEN NOT c AND o > 0.2 THEN CASE WHEN item_type = 'statistic' THEN 0.3 ELSE 0.15 END WHEN c AND o > 0.3 THEN confidence * 0.1 ELSE 0 END) AS raw,
  count(*) FILTER (NOT c AND o > 0.15) AS found, coalesce(sum(confidence * o) FILTER (NOT c AND o > 0.15), 0) AS strength, count(*) FILTER (item_type = 'claim' AND o > 0.2) AS counter
  FROM rpairs GROUP BY ALL"""
CTE["rscore"] = """SELECT p.*, coalesce(seen, 0) AS seen, coalesce(supporting, 0) AS supporting, coalesce(found, 0) AS found, coalesce(strength, 0) AS strength, coalesce(counter, 0) AS counter,
  greatest(least(coalesce(raw, 0) * CASE prediction_type WHEN 'quantitative_target' THEN CASE WHEN timeframe IS NULL THEN 0.8 ELSE 1 END * CASE WHEN coalesce(supporting, 0) = 0 THEN 0.5 ELSE 1 END
    WHEN 'cost_estimate' THEN CASE WHEN coalesce(supporting, 0) = 0 THEN 0.5 ELSE 1 END WHEN 'comparison_claim' THEN CASE WHEN coalesce(supporting, 0) = 0 THEN 0.4 ELSE 1 END
    WHEN 'qualitative_goal' THEN 0.7 ELSE CASE WHEN coalesce(supporting, 0) = 0 THEN 0.6 ELSE 1 END END, 1), 0) AS cred
  FROM preds p LEFT JOIN rsum s ON s.doc_id = p.doc_id AND s.prediction_no = p.prediction_no"""


def _mitems(s, d):
    return settle(extraction.item_rows(extraction.with_items(sections.single_section(marked_documents(s, d)))), "items")


def _assessed(s, d, items=None):
    items = _mitems(s, d) if items is None else items
    return settle(R.assess_credibility(settle(PREDS(s, d), "predictions"), extraction.claims_and_evidence(items)), "assessed")


@register("r5_credibility", f"""SELECT doc_id, prediction_no, prediction_type, supporting, {r6('cred')} AS credibility,
  CASE WHEN cred >= 0.7 THEN 'well_supported' WHEN cred >= 0.4 THEN 'partially_supported' WHEN cred >= 0.15 THEN 'aspirational' ELSE 'unsupported' END AS verdict,
  {r6('CASE WHEN seen = 0 THEN 0.3 ELSE least(supporting / 3.0, 1) * 0.5 + 0.3 END')} AS confidence FROM rscore""")
def _r5(s, d):
    return _assessed(s, d).select("doc_id", "prediction_no", "prediction_type", "supporting", "credibility", "verdict", "confidence")


_vs = "greatest(least(strength / 2, 1) - least(counter * 0.1, 0.3), 0)"
_fl = "CASE WHEN found = 0 AND cred > 0.5 THEN 'unverifiable' WHEN found > 0 AND cred < 0.2 THEN 'evidence_confirms' END"


@register("r7_verify_predictions", f"""SELECT doc_id, prediction_no, found AS evidence_found, {r6('strength')} AS evidence_strength, counter AS counter_evidence, {r6(_vs)} AS verification_score,
  found > 0 AS verified, {_fl} AS flag FROM rscore""")
def _r7(s, d):
    items = _mitems(s, d)
    return R.verify_predictions(_assessed(s, d, items), items)


@register("r8_prediction_report", f"SELECT doc_id, prediction_no, prediction_type, target_value, timeframe, {r6('cred')} AS credibility, found > 0 AS verified, {_fl} AS flag FROM rscore")
def _r8(s, d):
    items = _mitems(s, d)
    a = _assessed(s, d, items)
    return R.prediction_report(a, R.verify_predictions(a, items)).select(
        "doc_id", "prediction_no", "prediction_type", "target_value", "timeframe", "credibility", "verified", "flag")
