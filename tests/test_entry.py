import importlib
import sys

import duckdb
import pandas as pd
import pytest


def test_entry_works_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "flow_sessions" in entry.queries() and not [q for q in entry.queries() if q.startswith("op")]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """A few hundred events of a dozen users, as the driver's table has them."""
    where = tmp_path_factory.mktemp("sf")
    kinds = ["view", "click", "purchase", "error", "signup"]
    rows = [(k, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=(k * 7919) % 9000 * 11, microseconds=k), k * k % 12, kinds[k * k * 3 % 5], (k * 37 % 1500) / 7, "{}") for k in range(400)]
    df = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    df["ts"] = df["ts"].astype("datetime64[us]")
    df.to_parquet(where / "events.parquet")
    return where


@pytest.mark.parametrize("name", ["flow_sessions", "timing_bursts", "size_dominant", "tcp_state", "dup_ack", "rtt_asof", "splt_exploded", "seq_fold"])
def test_queries_equal_their_oracles(spark, tables, name):
    from rillstream.plans.oracle import all_sql
    from rillstream.plans.queries import QUERIES

    got = QUERIES[name](spark, str(tables)).toPandas()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tables}/events.parquet'")
    want = c.execute(all_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = (x[columns].sort_values(columns, ignore_index=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_fold_oracle_runs_on_a_stream_of_many_sessions(spark, tables):
    from rillstream.plans.queries import closed_sessions

    df = closed_sessions(spark, str(tables))
    assert df.count() == 400 and df.select("close_reason").distinct().count() >= 2
