"""Matching prompts against a lexicon of attack patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import lexicons as L, text as T
from plumbline.session import settle


def lexicon() -> list[tuple[str, str, str]]:
    """[(class, severity, pattern)]: the default lexicon, a literal of fixed size."""
    return [(c, s, p) for c, s, ps in L.THREATS for p in ps]


def subclass_closure(edges: DataFrame) -> DataFrame:
    """(child, ancestor) pairs of the transitive subclass relation, one join of the
    newly found pairs per level."""
    from plumbline.session import cut_lineage

    base = edges.select("child", "parent").distinct()
    step = base.select(F.col("child").alias("ancestor"), F.col("parent").alias("up"))
    found = cut_lineage(base.select("child", F.col("parent").alias("ancestor")))
    fresh = found
    while True:
        fresh = cut_lineage(fresh.join(step, "ancestor").select("child", F.col("up").alias("ancestor")).distinct().join(
            found, ["child", "ancestor"], "left_anti"))
        if fresh.isEmpty():
            return found
        found = cut_lineage(found.unionByName(fresh))


def attack_lexicon(classes: DataFrame, root: str = "Attack") -> DataFrame:
    """classes(class, parent, severity, lang, patterns) -> (class, severity, pattern):
    the pattern lists (";"-separated) of all descendants of the root class."""
    under = subclass_closure(classes.select(F.col("class").alias("child"), "parent")).where(F.col("ancestor") == root).select(
        F.col("child").alias("class"))
    p = classes.join(under, "class", "left_semi").select(
        "class", "severity", F.explode(F.split("patterns", ";")).alias("pattern"))
    return p.select("class", F.coalesce("severity", F.lit("medium")).alias("severity"), F.lower(T.ws_trim(F.col("pattern"))).alias("pattern")).where(
        "pattern <> ''").distinct()


def segments(c: Column) -> Column:
    """Pieces cut after . ! ? ; or a newline once longer than 3 bytes (shorter ones
    carry over), plus the whole prompt when there is more than one piece."""
    pieces = F.regexp_extract_all(c, F.lit(r"(?s)[^.!?\n;]*[.!?\n;]|[^.!?\n;]+\z"), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def step(acc, p):
        cur = F.concat(acc["cur"], p)
        full = F.octet_length(T.ws_trim(cur)) > 3
        return F.struct(
            F.when(full, F.concat(acc["out"], F.array(T.ws_trim(cur)))).otherwise(acc["out"]).alias("out"),
            F.when(full, F.lit("")).otherwise(cur).alias("cur"))

    cut = F.aggregate(pieces, start, step)["out"]
    return T.let(cut, lambda s: F.when(F.size(s) > 1, F.concat(s, F.array(c))).otherwise(s))


def _locate(prompts: DataFrame, candidates: Column) -> DataFrame:
    """Adds segments and threats: the candidates array<struct<class, severity, pattern>>
    that the prompt holds, with the first segment that does (80 characters)."""

    def find(segs):
        low = F.transform(segs, lambda s: F.lower(s))
        hit = T.let(F.lower(F.col("prompt")), lambda whole: F.filter(candidates, lambda p: F.contains(whole, p["pattern"])))

        def locate(ls):
            placed = F.transform(hit, lambda p: F.struct(p.alias("p"), F.array_position(
                F.transform(ls, lambda x: F.contains(x, p["pattern"])), F.lit(True)).cast("int").alias("at")))
            cut = lambda s: F.when(F.octet_length(s) > 80, F.concat(F.substring(s, 1, 80), F.lit("..."))).otherwise(s)
            return F.transform(F.filter(placed, lambda x: x["at"] > 0), lambda x: F.struct(
                x["p"]["class"].alias("class"), x["p"]["severity"].alias("severity"), x["p"]["pattern"].alias("pattern"),
                cut(F.get(segs, x["at"] - 1)).alias("text")))

        return F.struct(F.size(segs).alias("segments"), T.let(low, locate).alias("threats"))

    return prompts.withColumn("_f", T.let(segments(F.col("prompt")), find))


def match_threats(prompts: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Adds ``segments`` (count) and ``threats`` array<struct<class, severity,
    pattern, text>>: each (class, pattern) once, with the first segment holding it
    (80 characters).

    The default lexicon is a literal and the plan narrow; its patterns are looked for in
    segments only where the whole prompt holds them. A table of patterns (class, severity,
    pattern), of any size, goes through an index: see ``candidates``."""
    if patterns is None:
        lits = F.array(*[F.struct(F.lit(c).alias("class"), F.lit(s).alias("severity"), F.lit(p).alias("pattern")) for c, s, p in lexicon()])
        return _locate(prompts, lits).select(*prompts.columns, "_f.segments", "_f.threats")
    # prompts that share a hash share their candidates; what a prompt holds is looked up in it
    keyed = prompts.withColumn("_prompt_hash", F.xxhash64(F.coalesce("prompt", F.lit(""))))
    found = candidates(keyed.select("_prompt_hash", F.coalesce("prompt", F.lit("")).alias("prompt")), patterns)
    joined = keyed.join(found, "_prompt_hash", "left")
    none = F.array().cast(found.schema["_found"].dataType)
    return _locate(joined, F.coalesce("_found", none)).select(*prompts.columns, "_f.segments", "_f.threats")


#: Lengths, in characters, of the starts of parts by which prompts and patterns meet.
GRAMS = (1, 2, 3, 5)


def _grams(c: Column) -> Column:
    """The distinct substrings of GRAMS characters, or fewer at an end, of the words of a text."""
    words = F.filter(F.array_distinct(F.split(c, " ")), lambda w: w != "")
    cut = lambda w: lambda i: F.array(*[F.substring(w, i, F.lit(k)) for k in GRAMS])
    of_word = lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.char_length(w)), cut(w)))
    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def candidates(prompts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(_prompt_hash, _found): the patterns that each distinct prompt may hold, array<struct<class,
    severity, pattern>>. prompts: (_prompt_hash, prompt).

    Whatever holds a pattern holds each of its parts between blanks inside one word, so any
    one part will do as a key: one of four characters or more, if there is one, that the
    fewest patterns share. A prompt meets the key by its start, once. No table is collected;
    the keys are written, so that Spark knows their size and sends them to all while they
    are small. What is shuffled of a prompt is then the list of its patterns alone."""
    own = settle(patterns.select("class", F.coalesce("severity", F.lit("medium")).alias("severity"), "pattern").where("pattern <> ''").distinct(), "patterns")
    parts = own.select("pattern").distinct().select("pattern", F.explode(F.array_distinct(F.filter(F.split("pattern", " "), lambda w: w != ""))).alias("part"))
    size = F.char_length("part")
    rarest = parts.join(parts.groupBy("part").agg(F.count("*").alias("n")), "part").groupBy("pattern").agg(
        F.min_by("part", F.struct(size < 4, F.col("n"), -size, F.col("part"))).alias("part"))
    start = F.coalesce(*[F.when(size >= k, F.substring("part", 1, k)) for k in reversed(GRAMS)])
    keys = settle(own.join(rarest, "pattern").select(start.alias("gram"), F.struct("class", "severity", "pattern").alias("entry")), "keys")
    met = prompts.select("_prompt_hash", F.explode(_grams(F.lower("prompt"))).alias("gram")).join(keys, "gram")
    return met.groupBy("_prompt_hash").agg(F.array_sort(F.collect_set("entry")).alias("_found"))


def firewall_verdict(matched: DataFrame) -> DataFrame:
    """Adds allowed and reason; threats sorted by severity, class, pattern."""
    rank = lambda s: F.coalesce(F.nullif(F.array_position(T.lit_array(L.SEVERITY_ORDER), s), F.lit(0)), F.lit(9))
    ordered = F.transform(
        F.array_sort(F.transform("threats", lambda t: F.struct(rank(t["severity"]).alias("k"), t["class"].alias("c"), t["pattern"].alias("p"), t.alias("t")))),
        lambda x: x["t"])
    classes = F.array_sort(F.array_distinct(F.transform("threats", lambda t: F.concat(t["class"], F.lit("("), t["severity"], F.lit(")")))))
    ok = F.size("threats") == 0
    return matched.withColumns({
        "threats": ordered, "allowed": ok,
        "reason": F.when(ok, F.concat(F.col("segments").cast("string"), F.lit(" segments analyzed, no threats detected"))).otherwise(F.array_join(classes, ", "))})


def dual_check(verdicts: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Joins a second opinion (key, safe, reasoning, actions array<struct<action_type,
    safe, reason>>) to the verdicts: PASS, BLOCK or REVIEW."""
    d = verdicts.join(second, key)
    unsafe = F.filter("actions", lambda a: ~a["safe"])
    ok, safe = F.col("allowed"), F.col("safe")
    return d.withColumns({
        "verdict": F.when(ok & safe, "PASS").when(~ok & ~safe, "BLOCK").otherwise("REVIEW"),
        "deterministic_says": F.when(ok, "SAFE").otherwise(F.concat(F.lit("BLOCKED: "), "reason")),
        "second_says": F.when(safe, F.concat(F.lit("SAFE: "), "reasoning")).otherwise(F.concat(
            F.lit("BLOCKED: "), F.array_join(F.transform(unsafe, lambda a: F.concat(a["action_type"], F.lit("("), a["reason"], F.lit(")"))), ", ")))})


def classifier_eval(labelled: DataFrame) -> DataFrame:
    """Confusion cells, accuracy, precision, recall and F1 of blocked vs label."""
    b, y = ~F.col("allowed"), F.col("label") == 1
    tp, fp, fn, tn = (F.count_if(x) for x in (b & y, b & ~y, ~b & y, ~b & ~y))
    cells = labelled.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    ratio = lambda a, c: F.when(c > 0, a / F.nullif(c, F.lit(0))).otherwise(0.0)
    c = {k: F.col(k) for k in ("tp", "fp", "fn", "tn")}
    return cells.select(
        "*", ratio(c["tp"] + c["tn"], c["tp"] + c["tn"] + c["fp"] + c["fn"]).alias("accuracy"), ratio(c["tp"], c["tp"] + c["fp"]).alias("precision"),
        ratio(c["tp"], c["tp"] + c["fn"]).alias("recall"), ratio(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"]).alias("f1"))
