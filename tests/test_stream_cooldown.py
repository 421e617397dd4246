"""T3 on a stream: equal to the batch cool-down for any cut into files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantpulse.operators.alerts import cooldown_fired
from plantpulse.sources.readers import read_stream
from plantpulse.streaming import jobs as J
from plantpulse.streaming.stateful import cooldown

BEAT = -7


def frame(spark, rows, kind="timestamp"):
    ts = F.timestamp_micros(F.col("s") * 1_000_000 + F.col("id") % 7).cast(kind).alias("ts")
    df = spark.createDataFrame(rows, "dev string, part string, s long, id long, note string")
    return df.select("dev", "part", ts, "id", "note")


def fired_by_stream(spark, files, keys, root, kind="timestamp"):
    """What fires when the files come one per micro-batch, closed by a heartbeat."""
    last = max(r[2] for rows in files for r in rows if r[2] is not None)
    for rows in [*files, [("beat", "beat", last + 10**6, BEAT, None)]]:
        frame(spark, rows, kind).coalesce(1).write.mode("append").parquet(f"{root}/in")
    schema = frame(spark, files[0], kind).schema
    s = read_stream(spark, f"{root}/in", schema, "parquet", max_files_per_trigger=1)
    out = J.run_to_table(cooldown(s, keys, "ts", "id", 600, ["note"], "10 minutes"), "cooldown")
    assert out.schema["ts"].dataType == schema["ts"].dataType
    return {(r.id, r.ts, r.note, *(r[k] for k in keys)) for r in out.where(F.col("id") != BEAT).collect()}


def fired_by_batch(spark, files, keys, kind="timestamp"):
    df = frame(spark, [r for rows in files for r in rows], kind)
    return {(r.id, r.ts, r.note, *(r[k] for k in keys)) for r in cooldown_fired(df, keys, "ts", "id", 600).collect()}


@pytest.mark.parametrize("seed,kind", [(1, "timestamp"), (2, "timestamp_ntz")])
def test_any_cut_equals_batch(spark, tmp_path, seed, kind):
    """Rows out of order inside the delay, ties, NULL keys, NULL times."""
    rng = np.random.default_rng(seed)
    rows, key = [], [None, "x", "y", ""]
    for i in range(400):
        s = int(rng.integers(0, 30_000)) // 3 * 3
        rows.append((key[rng.integers(4)], key[rng.integers(2)], None if i % 29 == 0 else s, i, f"n{i}"))
    at = [r[2] if r[2] is not None else 0 for r in rows]
    order = np.argsort([a + rng.uniform(0, 590) for a in at])  # late by less than the delay
    files = [[rows[i] for i in part] for part in np.array_split(order, 5)]
    want = fired_by_batch(spark, files, ["dev", "part"], kind)
    assert 100 < len(want) < 390 and {(None, "x"), ("x", None)} <= {r[3:] for r in want}
    assert fired_by_stream(spark, files, ["dev", "part"], tmp_path, kind) == want


def test_the_earlier_row_fires_though_it_comes_later(spark, tmp_path):
    files = [[("a", "p", 1000, 1, "")], [("a", "p", 700, 2, "")], [("a", "p", 1305, 3, "")]]
    got = fired_by_stream(spark, files, ["dev"], tmp_path)
    assert {r[0] for r in got} == {2, 3} and got == fired_by_batch(spark, files, ["dev"])


def test_one_clock_for_all(spark, tmp_path):
    files = [[("a", "p", 1000, 1, ""), ("b", "p", 700, 2, "")], [(None, "p", 1305, 3, ""), ("c", "p", 1301, 4, "")],
             [("a", None, None, 5, "")]]
    got = fired_by_stream(spark, files, [], tmp_path)
    assert got == fired_by_batch(spark, files, []) and {r[0] for r in got} == {2, 4, 5}
