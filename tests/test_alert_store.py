"""Keyed upsert, versions, replayed batches."""

import pytest
from pyspark.sql import functions as F

from plantpulse.sources.alert_store import AlertStore

SCHEMA = "device string, state string, s long, message string"


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).select("device", "state", F.timestamp_seconds("s").alias("alert_ts"), "message")


def held(store):
    return {(r.device, r.state): (r.first_alert and r.first_alert.timestamp(), r.last_alert and r.last_alert.timestamp(), r.n_alerts, r.message)
            for r in store.read().collect()}


FIRST = [("a", "leak", 100, "m1"), ("a", "leak", 50, "m0"), (None, "leak", 70, "n"), ("b", None, None, "no time")]
SECOND = [("a", "leak", 90, "late"), ("a", "wear", 5, "w"), (None, "leak", 70, "o"), ("b", None, None, "no time")]
AFTER = {("a", "leak"): (50, 100, 3, "m1"), (None, "leak"): (70, 70, 2, "o"), ("b", None): (None, None, 2, None),
         ("a", "wear"): (5, 5, 1, "w")}


@pytest.mark.parametrize("buckets", [1, 64])
def test_batches_are_merged_by_key(spark, tmp_path, buckets):
    store = AlertStore(spark, str(tmp_path), ["device", "state"], buckets)
    with pytest.raises(ValueError):
        store.read()
    assert store.upsert(batch(spark, FIRST), 0) and store.upsert(batch(spark, SECOND), 1)
    assert held(store) == AFTER
    assert store.upsert(batch(spark, []), 2) and held(store) == AFTER


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    store = AlertStore(spark, str(tmp_path), ["device", "state"])
    for i in (0, 0, 1, 0, 1):
        store.upsert(batch(spark, [FIRST, SECOND][i]), i)
    assert held(store) == AFTER and store.manifest()["version"] == 2


def test_a_batch_that_fails_before_its_commit_is_not_read(spark, tmp_path, monkeypatch):
    store = AlertStore(spark, str(tmp_path), ["device", "state"])
    store.upsert(batch(spark, FIRST), 0)
    before = held(store)

    def lost(_):
        raise OSError("driver lost")
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lost)
        with pytest.raises(OSError):
            store.upsert(batch(spark, SECOND), 1)
    assert held(store) == before
    assert store.upsert(batch(spark, SECOND), 1) and held(store) == AFTER


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = AlertStore(spark, str(tmp_path), ["device", "state"], 64)
    store.upsert(batch(spark, [(f"d{i}", "x", i, "m") for i in range(300)]), 0)
    store.upsert(batch(spark, [("d7", "x", 1000, "again")]), 1)
    folders = list(store.manifest()["folders"].values())
    assert len(set(folders)) == 2 and sum(f.endswith("2") for f in folders) == 1
    assert held(store)[("d7", "x")] == (7, 1000, 2, "again") and store.read().count() == 300
