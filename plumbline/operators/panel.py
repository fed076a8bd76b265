"""Panel scores: disagreement, drift, reconciliation, trust, moderation, evidence feeds.

scores(session_id, round, agent_id, criterion_id, score, max_score). A panel and
a framework are small by definition; sessions may be many and of any size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import text as T

CELL = ["session_id", "round", "criterion_id"]


def _clip(c: Column, low, high) -> Column:
    return F.greatest(F.least(c, high if isinstance(high, Column) else F.lit(high)), F.lit(low))


def structural_panel_scores(structural: DataFrame, agents: list[tuple], criteria: list[tuple]) -> DataFrame:
    """One score per (document, agent, criterion): clamp(structural * max, 0, max).

    agents = [agent_id], criteria = [(criterion_id, max_score)]; both are fixed
    dimensions, held as array literals, so rows fan out in place."""
    a = T.lit_array(agents)
    c = F.array(*[F.struct(F.lit(i).alias("criterion_id"), F.lit(float(m)).alias("max_score")) for i, m in criteria])
    return structural.select("doc_id", "structural", F.explode(a).alias("agent_id")).select(
        "doc_id", "structural", "agent_id", F.inline(c)).select(
        "doc_id", "agent_id", "criterion_id", "max_score",
        F.greatest(F.least(F.col("structural") * F.col("max_score"), F.col("max_score")), F.lit(0.0)).alias("score"))


def disagreements(scores: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Pairs of one panel and criterion further apart than the threshold, as an
    equi-join on the cell; the pair order is by agent id."""
    a = scores.select(*CELL, F.col("agent_id").alias("agent_a"), F.col("score").alias("score_a"))
    b = scores.select(*CELL, F.col("agent_id").alias("agent_b"), F.col("score").alias("score_b"))
    return a.join(b, CELL).where("agent_a < agent_b").withColumn(
        "delta", F.abs(F.col("score_a") - F.col("score_b"))).where(F.col("delta") > threshold)


def drift(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Mean absolute change of each session's scores from the previous round, over
    (agent, criterion) present in both (0 if none), and whether it converged."""
    keys = ["session_id", "round", "agent_id", "criterion_id"]
    prev = scores.select("session_id", (F.col("round") + 1).alias("round"), "agent_id", "criterion_id", F.col("score").alias("before"))
    moved = scores.where("round > 1").join(prev, keys, "left")
    v = F.coalesce(F.avg(F.abs(F.col("score") - F.col("before"))), F.lit(0.0))
    return moved.groupBy("session_id", "round").agg(v.alias("drift"), (v < threshold).alias("converged"))


def debate_status(scores: DataFrame) -> DataFrame:
    n = disagreements(scores).groupBy("session_id", "round").agg(F.count("*").alias("disagreements"))
    rounds = scores.groupBy("session_id", "round").agg(F.count("*").alias("scores"))
    return rounds.join(n, ["session_id", "round"], "left").join(drift(scores), ["session_id", "round"], "left").select(
        "session_id", "round", "scores", F.coalesce("disagreements", F.lit(0)).alias("disagreements"), "drift",
        F.coalesce("converged", F.lit(False)).alias("converged"))


def reconcile(scores: DataFrame, threshold: float = 2.0, stop: float = 0.5, step: float = 0.3, rounds: int = 4) -> DataFrame:
    """Damped reconciliation of one round of panel scores, up to ``rounds`` times.

    In agent order every agent ahead of a target and further away than the
    threshold pulls it by ``step`` of the remaining distance. A session stops when
    nobody disagrees or its mean change falls below ``stop``. One session is one
    row of (panel x criteria) cells, so all rounds run in place."""
    cell = F.struct("criterion_id", "agent_id", "score", "max_score")
    s = scores.groupBy("session_id", "criterion_id", "agent_id").agg(F.max("score").alias("score"), F.max("max_score").alias("max_score"))
    s = s.groupBy("session_id").agg(F.array_sort(F.collect_list(cell)).alias("cells")).withColumns(
        {"active": F.lit(True), "used": F.lit(0)})

    def pulled(b):
        ahead = F.filter("cells", lambda a: (a["criterion_id"] == b["criterion_id"]) & (a["agent_id"] < b["agent_id"])
                         & (F.abs(a["score"] - b["score"]) > threshold))
        return F.aggregate(ahead, b["score"], lambda cur, a: F.greatest(
            F.least(cur + (a["score"] - cur) * step, b["max_score"]), F.lit(0.0)))

    for _ in range(rounds):
        s = s.withColumn("next", F.transform("cells", lambda b: b.withField("score", pulled(b))))
        differs = F.exists("cells", lambda b: F.exists("cells", lambda a: (a["criterion_id"] == b["criterion_id"]) & (
            a["agent_id"] < b["agent_id"]) & (F.abs(a["score"] - b["score"]) > threshold)))
        s = s.withColumn("go", F.col("active") & differs)
        change = F.aggregate(
            F.zip_with("cells", "next", lambda x, y: F.abs(x["score"] - y["score"])), F.lit(0.0), lambda t, v: t + v) / F.size("cells")
        s = s.select(
            "session_id", F.when(F.col("go"), F.col("next")).otherwise(F.col("cells")).alias("cells"),
            (F.col("go") & (change >= stop)).alias("active"), (F.col("used") + F.col("go").cast("int")).alias("used"))
    return s.select("session_id", F.col("used").alias("rounds_used"), F.inline("cells"))


#: Functions that one step of a fold composes.
FOLD = 1024


def trust_update(challenges: DataFrame, start: DataFrame | None = None, default: float = 0.5, width: int = FOLD) -> DataFrame:
    """Trust of every challenged agent in its challenger after all challenges in
    ``seq`` order: +0.1 (at most 1) when the score moved, else -0.05 (at least 0).

    A clamped addition followed by another is again one, (add, low, high). Challenges are
    numbered once in ranges; at each level ``width`` neighbours of a pair are composed to one,
    until every pair has one left. Groups hold at most ``width`` rows, so a pair with all
    challenges is folded by as many tasks as any other."""
    from plumbline.functions.ranking import global_row_number

    keys = ["session_id", "truster", "trustee"]
    delta = F.when(F.col("score_to").isNotNull(), 0.1).otherwise(-0.05)
    c = challenges.select("session_id", F.col("target").alias("truster"), F.col("challenger").alias("trustee"), "seq", delta.alias("delta"))
    numbered = global_row_number(c, [*keys, "seq", "delta"], "at", "rows")
    hold = lambda v: F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0))
    # of one challenge: whatever trust was before, it ends between hold(0 + delta) and hold(1 + delta)
    one = F.struct(F.col("delta").alias("add"), hold(F.col("delta")).alias("low"), hold(1.0 + F.col("delta")).alias("high"))
    rows = numbered.agg(F.max("rows")).first()[0] or 0
    folds, clamp = numbered.select(*keys, "at", one.alias("f")), lambda v, f: F.greatest(F.least(v + f["add"], f["high"]), f["low"])
    then = lambda f, g: F.struct((f["add"] + g["add"]).alias("add"), clamp(f["low"], g).alias("low"), clamp(f["high"], g).alias("high"))
    same = F.struct(F.lit(0.0).alias("add"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    while rows > 0:
        rows = rows // width
        folds = folds.groupBy(*keys, F.expr(f"at div {width}").alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "f"))).alias("fs")).select(
            *keys, "at", F.aggregate("fs", same, lambda f, x: then(f, x["f"])).alias("f"))
    base = F.lit(default)
    if start is not None:
        on = [k for k in keys if k in start.columns]
        folds = folds.join(start.select(*on, "trust_level"), on, "left")
        base = F.coalesce("trust_level", F.lit(default))
    return folds.select(*keys, clamp(base, F.col("f")).alias("trust_level"))


def moderate(scores: DataFrame, trust: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """Per criterion: mean, population deviation, trust-weighted consensus (weight =
    mean inbound trust within the session where trust has one, 1 when unknown, 0 when all weights are 0) and dissents, the
    scores more than two deviations from the mean."""
    trust = trust.withColumnRenamed("trustee", "agent_id")
    on = [k for k in ("session_id", "agent_id") if k in trust.columns and k in scores.columns]
    s = scores.join(trust.groupBy(*on).agg(F.avg("trust_level").alias("w")), on, "left").withColumn("w", F.coalesce("w", F.lit(1.0)))
    stats = s.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("score").alias("panel_mean"),
        F.when(F.count("*") < 2, 0.0).otherwise(F.stddev_pop("score")).alias("panel_std_dev"),
        F.when(F.sum("w") > 0, F.sum(F.col("score") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0.0))).otherwise(0.0).alias("consensus_score"))
    out = dissents(scores, stats, keys).groupBy(*keys).agg(F.count("*").alias("dissents"))
    return stats.join(out, keys, "left").fillna(0, subset=["dissents"])


def dissents(scores: DataFrame, stats: DataFrame, keys: list[str] = CELL) -> DataFrame:
    far = F.abs(F.col("score") - F.col("panel_mean"))
    return scores.join(stats.select(*keys, "panel_mean", "panel_std_dev"), keys).where(
        (F.col("panel_std_dev") > 0) & (far > 2.0 * F.col("panel_std_dev"))).select(
        *keys, "agent_id", "score", (far / F.col("panel_std_dev")).alias("deviations"))


def overall(moderated: DataFrame, criteria: DataFrame, keys: list[str], top: int = 3) -> DataFrame:
    """Weighted total, percentage, pass flag (null without a pass mark) and the
    strongest and weakest criteria; ties go to the smaller criterion id."""
    d = moderated.join(criteria, "criterion_id")
    ratio = F.when(F.col("max_score") > 0, F.col("consensus_score") / F.col("max_score")).otherwise(0.0)
    total, most = F.sum(F.col("consensus_score") * F.col("weight")), F.sum(F.col("max_score") * F.col("weight"))
    pct = F.when(most > 0, total / F.nullif(most, F.lit(0.0)) * 100.0).otherwise(0.0)
    agg = d.groupBy(*keys).agg(
        total.alias("total_score"), most.alias("max_possible"), pct.alias("percentage"), (pct >= F.max("pass_mark")).alias("passed"),
        F.array_sort(F.collect_list(F.struct((-ratio).alias("k"), "criterion_id"))).alias("best"),
        F.array_sort(F.collect_list(F.struct(ratio.alias("k"), "criterion_id"))).alias("worst"))
    names = lambda c: F.transform(F.slice(c, 1, top), lambda x: x["criterion_id"])
    return agg.select(*keys, "total_score", "max_possible", "percentage", "passed",
                      names("best").alias("top_strengths"), names("worst").alias("top_weaknesses"))


def most_contested(challenges: DataFrame) -> DataFrame:
    moved = F.coalesce(F.sum(F.abs(F.col("score_to") - F.col("score_from"))), F.lit(0.0))
    return challenges.groupBy("session_id", "criterion_id").agg(
        F.count("*").alias("challenges"), (F.count("*") + moved).alias("contentiousness"))


def latest_scores(recorded: DataFrame, order: list[str]) -> DataFrame:
    """Last recorded score per (session, criterion), whoever gave it."""
    return recorded.groupBy("session_id", "criterion_id").agg(
        F.max_by(F.struct("agent_id", "score", "max_score"), F.struct(*order)).alias("x")).select("session_id", "criterion_id", "x.*")


FEED_TYPES = {"quantified_data": "QuantifiedEvidence", "evidence": "Evidence", "citation": "Citation", "claim": "SubClaim"}


def feed_nodes(feed: DataFrame, *more: str) -> DataFrame:
    """(session_id, agent_id, criterion_id, source_id, evidence_type, text, strength)
    -> nodes of the graph of each (session, agent, criterion), score clamped; other
    columns to keep can be named."""
    kind = F.lit("Evidence")
    for k, v in FEED_TYPES.items():
        kind = F.when(F.col("evidence_type") == k, v).otherwise(kind)
    return feed.select(
        "session_id", "agent_id", "criterion_id",
        F.concat_ws(":", F.lit("urn:feed"), "agent_id", "criterion_id", "source_id").alias("node_id"), kind.alias("node_type"), "text",
        _clip(F.col("strength"), 0.0, 1.0).alias("score"), *more)


def feed_edges(nodes: DataFrame) -> DataFrame:
    return nodes.select("session_id", "agent_id", "criterion_id", F.col("node_id").alias("src"), F.lit("Supports").alias("edge_type"),
                        F.concat(F.lit("urn:criterion:"), "criterion_id").alias("dst"))


def inhibit(nodes: DataFrame, counter: DataFrame) -> DataFrame:
    """Counter-evidence (session_id, target_agent, criterion_id, challenger,
    source_id, text, strength) scales the target's node scores by
    1 - clamp(0.3 * mean strength, 0, 0.5) and joins them as Counter nodes."""
    keys = ["session_id", "agent_id", "criterion_id"]
    c = counter.withColumnRenamed("target_agent", "agent_id")
    factor = c.groupBy(*keys).agg((1.0 - _clip(F.avg("strength") * 0.3, 0.0, 0.5)).alias("factor"))
    scaled = nodes.join(factor, keys, "left").withColumn("score", F.col("score") * F.coalesce("factor", F.lit(1.0))).drop("factor")
    added = c.select(
        *keys, F.concat_ws(":", F.lit("urn:feed:challenge"), "challenger", "criterion_id", "source_id").alias("node_id"),
        F.lit("Counter").alias("node_type"), "text", _clip(F.col("strength"), 0.0, 1.0).alias("score"))
    return scaled.unionByName(added)


def panel_convergence(structural: DataFrame) -> DataFrame:
    """(session_id, criterion_id, agent_id, structural, max_score) -> mean and
    population variance per criterion with two agents or more; converged < 1."""
    v = F.col("structural") * F.col("max_score")
    return structural.groupBy("session_id", "criterion_id").agg(
        F.count("*").alias("agents"), F.avg(v).alias("mean_score"), F.var_pop(v).alias("variance")).where("agents >= 2").withColumn(
        "converged", F.col("variance") < 1.0)


def convergence_summary(per_criterion: DataFrame) -> DataFrame:
    return per_criterion.groupBy("session_id").agg(
        F.count("*").alias("criteria"), F.avg("variance").alias("average_variance"), F.bool_and("converged").alias("converged"))


def text_quality(c: Column) -> Column:
    from plumbline.functions import lexicons as L

    return T.quality_signal(T.word_count(c), T.occurrences_total(F.lower(c), L.EVIDENCE_WORDS), T.specificity_markers(c))


def revision_impact(versions: DataFrame, scores: DataFrame) -> DataFrame:
    """versions(doc_id, old_text, new_text), or (doc_id, old_quality, new_quality) if the texts lie in
    two tables that would have to be joined, scores(doc_id, criterion_id, score, max_score)
    -> estimated score after the revision."""
    if "old_text" in versions.columns:
        versions = versions.select("doc_id", text_quality(F.col("old_text")).alias("old_quality"), text_quality(F.col("new_text")).alias("new_quality"))
    delta = versions.select("doc_id", (F.col("new_quality") - F.col("old_quality")).alias("quality_delta"))
    new = _clip(F.col("score") + F.col("quality_delta") * F.col("max_score") * 0.3, 0.0, F.col("max_score"))
    return scores.join(delta, "doc_id").select(
        "doc_id", "criterion_id", "score", "quality_delta", new.alias("new_score"), (new - F.col("score")).alias("delta"))


def batches(samples: DataFrame, order: str, size: int) -> DataFrame:
    """Adds batch_no = floor(rank / size) by input order, without a global window."""
    from plumbline.functions.ranking import global_row_number

    return global_row_number(samples, [order], "_rn").withColumn(
        "batch_no", F.floor((F.col("_rn") - 1) / size)).drop("_rn")


def batch_prompts(batched: DataFrame, order: str) -> DataFrame:
    """One prompt text per batch: its samples in order (a batch has a fixed size)."""
    block = F.concat(F.lit("### "), F.col("id").cast("string"), F.lit("\n"), F.col("text"))
    return batched.groupBy("batch_no").agg(
        F.count("*").alias("samples"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b")))), lambda x: x["b"]), "\n\n").alias("prompt"))


# --- report tables -------------------------------------------------------------
def scorecard(moderated: DataFrame, criteria: DataFrame, keys: list[str]) -> DataFrame:
    d = moderated.join(criteria, "criterion_id", "left")
    weight = F.coalesce("weight", F.lit(1.0))
    return d.select(
        *keys, "criterion_id", F.coalesce("title", "criterion_id").alias("title"), "consensus_score",
        F.coalesce("max_score", F.lit(0.0)).alias("max_score"), weight.alias("weight"),
        (F.col("consensus_score") * weight).alias("weighted"), "dissents")


def recommendations(moderated: DataFrame, criteria: DataFrame, last_gaps: DataFrame, keys: list[str], below: float = 0.7) -> DataFrame:
    """Criteria under 70 % of their maximum with the gaps named in the last round:
    one row per gap, or one row with a null gap."""
    d = moderated.join(criteria.where("max_score > 0"), "criterion_id").withColumn("ratio", F.col("consensus_score") / F.col("max_score"))
    return d.where(F.col("ratio") < below).join(last_gaps, [*keys, "criterion_id"], "left").select(
        *keys, "criterion_id", "title", "consensus_score", "ratio", "gap")


def gap_report(gaps: DataFrame, criteria: DataFrame) -> DataFrame:
    """One row per gap of alignment.alignment_gaps: the criterion's title (its id where it has
    none), what was found, and the best match's confidence in whole percent."""
    titles = criteria.select("criterion_id", "title").distinct()
    partial = F.col("best_section").isNotNull()
    return gaps.join(titles, "criterion_id", "left").select(
        "doc_id", "criterion_id", F.coalesce("title", "criterion_id").alias("title"), F.when(partial, "partial match").otherwise("no matching content").alias("finding"),
        "best_section", F.when(partial, F.round(F.col("best_confidence") * 100.0)).alias("confidence_pct"))


def executive_summary(totals: DataFrame, moderated: DataFrame, scores: DataFrame, criteria: DataFrame, keys: list[str]) -> DataFrame:
    """One row per session: score, result against the pass mark (null without one), criteria
    evaluated, rounds of the debate, strengths and weaknesses. ``totals`` is what overall() gives;
    sessions without rounds have 0."""
    marks = moderated.join(criteria.select("criterion_id", "pass_mark"), "criterion_id", "left").groupBy(*keys).agg(
        F.count("*").alias("criteria_evaluated"), F.max("pass_mark").alias("pass_mark"))
    rounds = scores.select(*keys, "round").distinct().groupBy(*keys).agg(F.count("*").alias("debate_rounds"))
    return totals.join(marks, keys, "left").join(rounds, keys, "left").select(
        *keys, "total_score", "max_possible", "percentage", "pass_mark", F.when(F.col("passed"), "PASS").when(~F.col("passed"), "FAIL").alias("result"),
        F.coalesce("criteria_evaluated", F.lit(0)).alias("criteria_evaluated"), F.coalesce("debate_rounds", F.lit(0)).alias("debate_rounds"), "top_strengths", "top_weaknesses")


def panel_list(scores: DataFrame, agents: DataFrame) -> DataFrame:
    """The agents that scored in a session, with name, role and domain; an agent that the table
    (agent_id, name, role, domain) does not know goes by its id."""
    seen = scores.select("session_id", "agent_id").distinct()
    return seen.join(agents.select("agent_id", "name", "role", "domain"), "agent_id", "left").select(
        "session_id", "agent_id", F.coalesce("name", "agent_id").alias("name"), "role", "domain")


def debate_trail(scores: DataFrame, challenges: DataFrame) -> DataFrame:
    """Per session and round: scores, challenges, moved scores, drift."""
    k = ["session_id", "round"]
    ch = challenges.groupBy(*k).agg(F.count("*").alias("challenges"), F.count("score_to").alias("moved"))
    return debate_status(scores).join(ch, k, "left").fillna(0, subset=["challenges", "moved"])


def lineage(sources: dict[str, DataFrame]) -> DataFrame:
    """Stage rows (session_id, stage_no, stage, n) from per-stage tables keyed by session_id."""
    parts = [
        df.groupBy("session_id").agg(F.count("*").alias("n")).select("session_id", F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), "n")
        for i, (name, df) in enumerate(sources.items())]
    return reduce(DataFrame.unionByName, parts)
