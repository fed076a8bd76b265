"""Forward-looking statements inside documents: detection, credibility, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import lexicons as L, text as T

MIN_SENTENCE = 10
WHOLE_WORD = r"(?<![\p{L}\p{N}])(?:%s)(?![\p{L}\p{N}])"


def is_past_fact(low: Column) -> Column:
    return F.rlike(low, F.lit(WHOLE_WORD % "|".join(L.PAST_MARKERS))) & ~T.contains_any(low, L.FUTURE_MARKERS)


def prediction_type(s: Column, low: Column) -> Column:
    """First of six detectors, or null."""
    digit, size = F.rlike(s, F.lit("[0-9]")), F.octet_length(s)
    has = lambda words: T.contains_any(low, words)
    return (
        F.when(has(L.TARGET_WORDS) & digit & has(L.TARGET_UNITS), "quantitative_target")
        .when(has(L.COST_WORDS) & has(L.COST_SIZES) & has(L.COST_PERIODS), "cost_estimate")
        .when(has(L.TIMELINE_WORDS) & has(L.TIMELINE_ACTIONS) & (size > 30), "timeline")
        .when(has(L.COMPARISON_WORDS) & digit, "comparison_claim")
        .when(has(L.GOAL_WORDS) & ~digit & (size > 25), "qualitative_goal")
        .when(has(L.PLEDGE_WORDS) & (size > 20), "commitment"))


def target_value(s: Column) -> Column:
    """First quantity: a run of digits and . , % £ $ with a closing M, B, K or m. A
    run of one byte goes on at the next such character."""
    n = "0-9.,%£$"
    run = F.regexp_extract(s, rf"^[^{n}]*([{n}]+)", 1)
    unit = F.regexp_extract(s, rf"^[^{n}]*[{n}]+([MBKm])", 1)
    more = F.regexp_extract(s, rf"^[^{n}]*[{n}][^{n}MBKm]*([MBKm]|[{n}]+[MBKm]?)", 1)
    return F.when(F.octet_length(run) >= 2, F.concat(run, unit)).when(more != "", F.concat(run, more))


def timeframe(low: Column) -> Column:
    tail = lambda start, limit: F.coalesce(
        F.nullif(F.regexp_extract(low, rf"(?s)^.*?({start}[^.]*)\.", 1), F.lit("")),
        F.nullif(F.regexp_extract(low, rf"(?s)^.*?({start}[^,]*),", 1), F.lit("")),
        F.regexp_extract(low, rf"(?s)^.*?({start}.{{0,{limit}}})", 1))
    starts = "|".join(L.BY_STARTS)
    by_ok = F.rlike(low, F.lit(rf"^(?s:(?:(?!by ).)*)by \s*(?:{starts})"))
    at = F.position(F.lit("months"), low)
    around = F.substr(low, F.greatest(at - 10, F.lit(1)), F.least(at - 1, F.lit(10)) + 20)
    return F.when(F.contains(low, F.lit("within")), tail("within", 34)).when(by_ok, tail("by ", 27)).when(
        at > 0, T.ws_trim(around))


def predictions(c: Column) -> Column:
    """array<struct<text, prediction_type, target_value, timeframe>> of one text,
    near-duplicates (same type and Jaccard over 0.35, or over 0.8) removed in order."""
    sents = F.transform(T.sentences_dot(c, MIN_SENTENCE), lambda s: F.struct(s.alias("t"), F.lower(s).alias("l")))
    typed = F.filter(F.transform(sents, lambda s: F.struct(
        s["t"].alias("t"), s["l"].alias("l"), prediction_type(s["t"], s["l"]).alias("k"))),
        lambda x: x["k"].isNotNull())
    found = F.transform(F.filter(typed, lambda x: ~is_past_fact(x["l"])), lambda x: x.withField(
        "w", F.array_distinct(F.filter(T.words(x["l"]), lambda w: F.octet_length(w) > 2))))

    def same(k, x):
        j = T.jaccard(k["w"], x["w"])
        return ((k["k"] == x["k"]) & (j > 0.35)) | (j > 0.8)

    numeric = lambda x: x["k"].isin("quantitative_target", "cost_estimate", "comparison_claim")
    return F.transform(T.greedy_keep(found, same), lambda x: F.struct(
        x["t"].alias("text"), x["k"].alias("prediction_type"), F.when(numeric(x), target_value(x["t"])).alias("target_value"),
        F.when(x["k"] != "comparison_claim", timeframe(x["l"])).alias("timeframe")))


def prediction_rows(documents: DataFrame) -> DataFrame:
    """(doc_id, prediction_no, ...) per document text."""
    return documents.select("doc_id", F.posexplode(predictions(F.col("text"))).alias("prediction_no", "p")).select(
        "doc_id", "prediction_no", "p.*")


def _overlaps(preds: DataFrame, items: DataFrame, carried: list[str]) -> DataFrame:
    """(doc_id, prediction_no, carried, n, o): pairs of a document that share a keyword, o being the share
    of the prediction's keywords (repeats count) that the item has, n how often the item occurs.

    Keywords are postings: predictions and items meet on (document, keyword), so a document with
    any number of items is spread over its keywords and pairs without a common one never form."""
    keys = lambda df: T.keywords_list(F.col("text"), L.STOP_PREDICT)
    p = preds.select("doc_id", "prediction_no", keys(preds).alias("pk")).select(
        "doc_id", "prediction_no", F.size("pk").alias("size"),
        F.inline(F.transform(F.array_distinct("pk"), lambda w: F.struct(w.alias("word"), F.size(F.filter("pk", lambda x: x == w)).alias("m")))))
    i = items.select("doc_id", *carried, F.array_distinct(keys(items)).alias("ik"), F.xxhash64(F.lit(1), "text", *carried).alias("h1"), F.xxhash64(F.lit(2), "text", *carried).alias("h2"))
    i = i.groupBy("doc_id", "h1", "h2").agg(F.count("*").alias("n"), F.first("ik").alias("ik"), *[F.first(c).alias(c) for c in carried])
    i = i.select("doc_id", "h1", "h2", "n", *carried, F.explode("ik").alias("word"))
    pairs = p.join(i, ["doc_id", "word"]).groupBy("doc_id", "prediction_no", "h1", "h2").agg(
        F.sum("m").alias("shared"), F.first("size").alias("size"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in carried])
    return pairs.select("doc_id", "prediction_no", *carried, "n", (F.col("shared") / F.col("size")).alias("o"))


def assess_credibility(preds: DataFrame, items: DataFrame) -> DataFrame:
    """Scores each prediction against the claims and evidence of its document.

    items(doc_id, role, text, specificity, quantified). They meet by keywords, and pairs
    collapse to sums before anything else is attached."""
    x = _overlaps(preds, items, ["role", "specificity", "quantified"])
    ev = F.col("role") == "evidence"
    hit = ev & (F.col("o") > 0.2)
    sums = x.groupBy("doc_id", "prediction_no").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("supporting"),
        F.coalesce(F.sum(F.col("n") * F.when(hit, F.when(F.col("quantified"), 0.3).otherwise(0.15)).when(
            ~ev & (F.col("o") > 0.3), F.col("specificity") * 0.1)), F.lit(0.0)).alias("raw"))
    seen = items.groupBy("doc_id").agg(F.count_if(ev).alias("evidence_seen"))
    preds = preds.join(seen, "doc_id", "left")
    d = preds.join(sums, ["doc_id", "prediction_no"], "left").fillna(0, subset=["evidence_seen", "supporting", "raw"])
    kind, alone = F.col("prediction_type"), F.col("supporting") == 0
    factor = (
        F.when(kind == "quantitative_target", F.when(F.col("timeframe").isNull(), 0.8).otherwise(1.0) * F.when(alone, 0.5).otherwise(1.0))
        .when(kind == "cost_estimate", F.when(alone, 0.5).otherwise(1.0)).when(kind == "comparison_claim", F.when(alone, 0.4).otherwise(1.0))
        .when(kind == "qualitative_goal", F.lit(0.7)).otherwise(F.when(alone, 0.6).otherwise(1.0)))
    score = F.greatest(F.least(F.col("raw") * factor, F.lit(1.0)), F.lit(0.0))
    d = d.withColumn("credibility", score)
    s = F.col("credibility")
    return d.withColumns({
        "verdict": F.when(s >= 0.7, "well_supported").when(s >= 0.4, "partially_supported").when(s >= 0.15, "aspirational").otherwise("unsupported"),
        "confidence": F.when(F.col("evidence_seen") == 0, 0.3).otherwise(F.least(F.col("supporting") / 3.0, F.lit(1.0)) * 0.5 + 0.3),
    }).drop("evidence_seen", "raw")


def verify_predictions(assessed: DataFrame, items: DataFrame) -> DataFrame:
    """items(doc_id, item_type, text, confidence): supporting items, counter-claims,
    score and a flag when credibility and evidence disagree."""
    x = _overlaps(assessed, items, ["item_type", "confidence"])
    hit = F.col("item_type").isin("statistic", "citation", "evidence") & (F.col("o") > 0.15)
    counter = (F.col("item_type") == "claim") & (F.col("o") > 0.2)
    sums = x.groupBy("doc_id", "prediction_no").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("evidence_found"),
        F.coalesce(F.sum(F.when(hit, F.col("n") * F.col("confidence") * F.col("o"))), F.lit(0.0)).alias("evidence_strength"),
        F.sum(F.when(counter, F.col("n")).otherwise(0)).alias("counter_evidence"))
    d = assessed.select("doc_id", "prediction_no", "credibility").join(sums, ["doc_id", "prediction_no"], "left").fillna(
        0, subset=["evidence_found", "evidence_strength", "counter_evidence"])
    score = F.greatest(F.least(F.col("evidence_strength") / 2.0, F.lit(1.0)) - F.least(F.col("counter_evidence") * 0.1, F.lit(0.3)), F.lit(0.0))
    ok = F.col("evidence_found") > 0
    return d.select(
        "doc_id", "prediction_no", "evidence_found", "evidence_strength", "counter_evidence", score.alias("verification_score"), ok.alias("verified"),
        F.when(~ok & (F.col("credibility") > 0.5), "unverifiable").when(ok & (F.col("credibility") < 0.2), "evidence_confirms").alias("flag"))


def prediction_report(assessed: DataFrame, checks: DataFrame) -> DataFrame:
    return assessed.join(checks, ["doc_id", "prediction_no"], "left")
