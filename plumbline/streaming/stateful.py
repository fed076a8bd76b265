"""Streams with keyed state that expires by event time: counts, latest scores, drift.

Counts and latest scores are kept by key and time window in the JVM's state store; a window's
state goes when the watermark has passed it, and what the windows have said adds up. Drift
needs the score of the round before, so each cell of a panel keeps its sums and a timer:
when the watermark has passed the cell's newest row by ``idle``, its state goes. Keys are
fine (a cell, not a session), so a session that holds most rows is spread over tasks. Rows behind
the watermark are dropped by Spark and counted: see ``late_rows``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CELL = ["session_id", "agent_id", "criterion_id"]


def use_state_store(spark: SparkSession) -> None:
    """Timers need this store; set before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def late_rows(query) -> int:
    """Rows that a query has dropped because they were behind the watermark."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


def state_rows(query) -> list[int]:
    """Rows in the state store after each micro-batch."""
    return [sum(int(op["numRowsTotal"]) for op in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]


def _timed(stream: DataFrame, ts: str, late: str) -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)  # watermarks need a zoned type


def evidence_counts(feed_nodes: DataFrame, evidence: list[str], ts: str = "ts", late: str = "1 day", size: str = "1 day") -> DataFrame:
    """Stream of nodes (session_id, agent_id, criterion_id, node_type, ts) to running counts of
    each key and window (update mode); see ``evidence_of_changes``."""
    counts = _timed(feed_nodes, ts, late).groupBy(F.window(ts, size).alias("w"), *CELL).agg(
        F.count("*").alias("nodes"), F.count_if(F.col("node_type").isin(evidence)).alias("evidence"))
    return counts.select(F.col("w.start").alias("window_start"), *CELL, "nodes", "evidence")


def evidence_of_changes(changes: DataFrame) -> DataFrame:
    """Counts of each key so far and the structural score they give: the newest row of a
    window holds, and windows add up. Fed edges point at the criterion, so every node is
    connected while coverage and depth stay 0."""
    counts = changes.groupBy("window_start", *CELL).agg(F.max("nodes").alias("nodes"), F.max("evidence").alias("evidence"))
    agg = counts.groupBy(*CELL).agg(F.sum("nodes").alias("nodes"), F.sum("evidence").alias("evidence"))
    density = F.least(F.log(F.col("nodes") + 1.0) / F.log(F.lit(12.0)), F.lit(1.0))
    return agg.withColumn("structural", F.least(0.25 * density + 0.20 * F.col("evidence") / F.col("nodes") + 0.20, F.lit(1.0)))


def latest_scores(recorded: DataFrame, ts: str = "ts", late: str = "1 day", size: str = "1 day") -> DataFrame:
    """Stream of scores (session_id, criterion_id, agent_id, score, max_score, event_id, ts) to the last
    one of each key and window (update mode); see ``latest_of_changes``."""
    last = F.max(F.struct(F.col(ts).alias("at"), "event_id", "agent_id", "score", "max_score")).alias("last")
    return _timed(recorded, ts, late).groupBy(F.window(ts, size).alias("w"), "session_id", "criterion_id").agg(last).select(
        "session_id", "criterion_id", "last")


def latest_of_changes(changes: DataFrame) -> DataFrame:
    """The last score of each key, by time, then by event."""
    return changes.groupBy("session_id", "criterion_id").agg(F.max("last").alias("last")).select(
        "session_id", "criterion_id", "last.agent_id", "last.score", "last.max_score")


class _Drift(StatefulProcessor):
    """(session, agent, criterion): sums of each round's values, in one value of state. Scores of
    neighbouring rounds give the change; what a new row alters is handed on as a difference.
    One timer is due after the key's first row; when it fires too early it is set anew."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "newest long, rounds array<int>, units array<bigint>, n array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new: dict[int, list[int]] = {}
        newest = 0
        for row in rows:
            sums = new.setdefault(row["round"], [0, 0])
            sums[0] += row["units"]
            sums[1] += 1
            newest = max(newest, row["event_ms"])
        was = self.sums.get()
        if was is None:
            self.handle.registerTimer(newest + self.idle_ms)
        old = {r: (u, n) for r, u, n in zip(was[1], was[2], was[3])} if was is not None else {}
        now = dict(old)
        for r, (u, n) in new.items():
            now[r] = (old.get(r, (0, 0))[0] + u, old.get(r, (0, 0))[1] + n)
        order = sorted(now)
        self.sums.update((max(newest, was[0] if was is not None else 0), order, [now[r][0] for r in order], [now[r][1] for r in order]))
        score = lambda s, r: min(10.0, s[r][0] / (s[r][1] * 1000.0))
        moved = lambda s, r: (abs(score(s, r) - score(s, r - 1)), 1) if r in s and r - 1 in s else (0.0, 0)
        for r in sorted({x for r in new for x in (r, r + 1)}):
            before, after = moved(old, r), moved(now, r)
            if r > 1 and (after != before or (r in new and r not in old)):
                yield Row(session_id=key[0], round=r, moved=after[0] - before[0], cells=after[1] - before[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        was = self.sums.get()
        due = was[0] + self.idle_ms if was is not None else 0
        if due > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(due)
        else:
            self.sums.clear()
        return iter([])

    def close(self) -> None:
        pass


def drift_changes(values: DataFrame, ts: str = "ts", late: str = "1 day", idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """Stream of values (session_id, round, agent_id, criterion_id, units, ts), units being
    hundredths that are summed up to a score, to changes (session_id, round, moved, cells) in
    append mode. See ``drift_of_changes``."""
    use_state_store(values.sparkSession)
    timed = _timed(values.withColumn("round", F.col("round").cast("int")), ts, late).withColumn("event_ms", F.unix_millis(ts))
    return timed.groupBy(*CELL).transformWithState(
        statefulProcessor=_Drift(idle_ms), outputStructType="session_id long, round int, moved double, cells int", outputMode="append", timeMode="eventTime")


def drift_of_changes(changes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Drift of each session and round, as panel.drift has it, from all changes so far. A cell
    that comes back after its state has gone moves from its next round on."""
    sums = changes.groupBy("session_id", "round").agg(F.sum("moved").alias("moved"), F.sum("cells").alias("cells"))
    drift = F.when(F.col("cells") > 0, F.greatest(F.col("moved"), F.lit(0.0)) / F.col("cells")).otherwise(0.0)
    return sums.select("session_id", "round", drift.alias("drift"), (drift < threshold).alias("converged"))
