"""Keyed stream state: expiry by event time, late rows, changes that add up."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators import panel
from plumbline.streaming import stateful, streams

DAY = 86_400_000
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def stream_of(spark, tmp_path):
    """A stream of batches, one micro-batch each."""
    def make(batches, schema):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(tmp_path / "in"))
    return make


def run(df, folder, writer):
    q = writer(df, str(folder / "out"), str(folder / "cp"))
    q.awaitTermination()
    return q


def test_old_windows_lose_their_state_and_late_rows_are_counted(spark, tmp_path, stream_of):
    schema = "session_id long, agent_id string, criterion_id string, node_type string, ts timestamp"
    at = lambda day, s, k="Evidence": (s, "a", "c", k, T0 + dt.timedelta(days=day))
    batches = [
        [at(0, s) for s in range(20)], [at(1, 1), at(1, 1, "SubClaim")], [at(30, 50)], [at(31, 50)],
        [at(2, 3), at(3, 4)],  # behind the watermark
        [at(31, 1)]]  # comes back after its state has gone
    q = run(stateful.evidence_counts(stream_of(batches, schema), streams.EVIDENCE), tmp_path, streams.write_changes)
    assert stateful.late_rows(q) == 2
    sizes = stateful.state_rows(q)
    assert max(sizes) >= 20 and sizes[-1] <= 4
    got = {r.session_id: (r.nodes, r.evidence) for r in stateful.evidence_of_changes(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {**{s: (1, 1) for s in range(20)}, 1: (4, 3), 50: (2, 2)}


def test_idle_cells_lose_their_state(spark, tmp_path, stream_of):
    schema = "session_id long, round int, agent_id string, criterion_id string, units long, ts timestamp"
    at = lambda day, s, r, u: (s, r, "a", "c", u, T0 + dt.timedelta(days=day))
    batches = [[at(0, s, 1, 1000) for s in range(20)], [at(4, 1, 2, 2000)], [at(7, 60, 1, 0)], [at(8, 1, 3, 4000)], [at(40, 70, 1, 0)], [at(41, 70, 2, 500)], [at(41, 1, 4, 0)]]
    q = run(stateful.drift_changes(stream_of(batches, schema), idle_ms=5 * DAY), tmp_path, streams.write_append)
    sizes = stateful.state_rows(q)
    assert sizes[-1] < max(sizes) / 2
    got = {(r.session_id, r.round): r.drift for r in stateful.drift_of_changes(spark.read.parquet(str(tmp_path / "out"))).collect()}
    # cell 1 was kept over days 4 to 8 by its rows, and had gone by day 41
    assert got == {(1, 2): 1.0, (1, 3): 2.0, (1, 4): 0.0, (70, 2): 0.5}


def test_drift_by_changes_is_the_drift_of_the_table(spark, tmp_path, stream_of):
    schema = "session_id long, round int, agent_id string, criterion_id string, units long, ts timestamp"
    rows = [(s, 1 + (i * 7 + s) % 4, f"a{i % 3}", f"c{(i + s) % 2}", 37 * i + 11 * s, T0 + dt.timedelta(hours=i)) for s in range(4) for i in range(40)]
    batches = [rows[i::5] for i in range(5)]
    run(stateful.drift_changes(stream_of(batches, schema), late="30 days"), tmp_path, streams.write_append)
    got = stateful.drift_of_changes(spark.read.parquet(str(tmp_path / "out")))
    table = spark.createDataFrame(rows, schema).groupBy("session_id", "round", "agent_id", "criterion_id").agg(
        F.least(F.lit(10.0), F.sum("units") / (F.count("*") * 1000.0)).alias("score"))
    key = lambda r: (r.session_id, r.round, round(r.drift, 9), r.converged)
    assert sorted(map(key, got.collect())) == sorted(map(key, panel.drift(table).collect()))


def test_latest_scores(spark, tmp_path, stream_of):
    schema = "session_id long, criterion_id string, agent_id string, score double, max_score double, event_id long, ts timestamp"
    row = lambda s, e, day, x: (s, "c", f"a{e}", x, 10.0, e, T0 + dt.timedelta(days=day))
    batches = [[row(1, 1, 0, 1.0), row(1, 2, 1, 2.0), row(2, 3, 0, 3.0)], [row(1, 4, 1, 4.0), row(2, 5, 0, 5.0)], [row(2, 6, 9, 6.0), row(1, 7, 0.5, 7.0)]]
    run(stateful.latest_scores(stream_of(batches, schema), late="30 days"), tmp_path, streams.write_changes)
    now = stateful.latest_of_changes(spark.read.parquet(str(tmp_path / "out")))
    assert sorted((r.session_id, r.agent_id, r.score) for r in now.collect()) == [(1, "a4", 4.0), (2, "a6", 6.0)]
