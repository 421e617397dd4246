"""Plan-shape checks: the physical plans keep the properties the scale design
relies on (pushdown, pruning, no pair expansion, skew-safe partitioning)."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from plantpulse.operators import windows as W
from tests.conftest import SF_SMALL

Q, O = E.queries(), E.oracle_sql()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in O if not n.startswith("stream_")))
def test_no_pair_expansion(spark, name):
    p = plan(Q[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_filters_reach_the_scan(spark):
    p = plan(Q["alert_cooldown_errors"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)" in p


def test_columns_are_pruned(spark):
    p = plan(Q["distinct_states"](spark, SF_SMALL))
    assert "ReadSchema: struct<event_type:string>" in p


def test_hot_device_is_split_into_chunks(spark):
    rows = [(0 if i % 10 else 1, i, i * 3, float(i % 7)) for i in range(400)]  # device 0 holds 90 %
    df = spark.createDataFrame(rows, "dev int, id long, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    out = W.rows_window(df, ["dev"], ["ts", "id"], lambda w: {"m": F.avg("v").over(w.rowsBetween(-20, -1))},
                        preceding=20, chunk_rows=50)
    p = plan(out)
    assert "_pp_chunk" in p and "BroadcastHashJoin" in p
    # the full-data shuffle is keyed by (device, chunk), never by device alone
    assert re.search(r"hashpartitioning\(dev#\d+, _pp_chunk#\d+L?", p)
    plain = W.rows_window(df, ["dev"], ["ts", "id"], lambda w: {"m": F.avg("v").over(w.rowsBetween(-20, -1))},
                          preceding=20, chunk_rows=None)
    a = sorted((r.id, r.m) for r in out.collect())
    b = sorted((r.id, r.m) for r in plain.collect())
    assert a == b


def test_small_devices_use_plain_windows(spark):
    p = plan(Q["window_features_lagged"](spark, SF_SMALL))
    assert "_pp_chunk" not in p


@pytest.mark.parametrize("how", [{"chunk_rows": None}, {"chunk_rows": 9}])
def test_backward_fill_runs_over_the_reversed_order(spark, how):
    """A frame that ends with the partition costs the square of a key's rows."""
    rows = [(i % 3 or None, None if i % 11 == 0 else i // 2, i, None if i % 4 else float(i)) for i in range(80)]
    df = spark.createDataFrame(rows, "dev int, s long, id long, v double")
    out = W.forward_fill(df, ["dev"], ["s", "id"], ["v"], ts_col="s", backward=True, **how)
    assert "unboundedfollowing" not in plan(out)
    want = {}
    for dev in (None, 1, 2):
        mine, known = sorted((r for r in rows if r[0] == dev), key=lambda r: (r[1] is not None, r[1] or 0, r[2])), None
        for r in reversed(mine):
            want[r[2]] = known = r[3] if r[3] is not None else known
    assert {r.id: r.v for r in out.collect()} == want


def test_stats_back_joins_are_broadcast(spark):
    p = plan(Q["pump_histogram"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in p
