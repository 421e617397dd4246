"""Keyed alert table (S6, S7): one row per key with its first and last alert,
the number of alerts and the last message, kept up to date by ``foreachBatch``.

A batch is merged in and committed as a new version. The table is cut into
buckets by the key's hash; a version writes the buckets it touches into a folder
of its own, and a manifest of that version names the folder of every bucket. The
manifest is renamed into place last: readers see the old version or the new
one, a batch that fails half-way leaves nothing behind that is read, and a
replayed batch (an id that a version has committed already) changes nothing.

NULL keys are keys; alerts without a time count and are never first or last;
of alerts with the same time the largest message is the last one.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .manifests import Manifests


class AlertStore:
    """The table under ``path``. ``keys`` and the types of their columns are
    those of the first batch; every batch has (keys, alert_ts, message)."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.manifests = Manifests(spark, path)

    # ---- versions

    def manifest(self) -> dict:
        """The newest committed version: its number, the last batch id, the
        schema, and the folder of every bucket that has rows."""
        return self.manifests.newest() or {"version": 0, "batch": -1, "schema": None, "folders": {}}

    def _commit(self, manifest: dict) -> None:
        self.manifests.commit(manifest)

    # ---- rows

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, manifest: dict, buckets: Sequence[int] | None = None) -> DataFrame | None:
        at = [f"{folder}/_bucket={b}" for b, folder in manifest["folders"].items() if buckets is None or int(b) in buckets]
        if manifest["schema"] is None or not at:
            return None
        return self.spark.read.schema(T.StructType.fromJson(manifest["schema"])).parquet(*at)

    def read(self) -> DataFrame:
        """(keys, first_alert, last_alert, n_alerts, message) of the newest version."""
        manifest = self.manifest()
        rows = self._rows(manifest)
        if rows is None:
            raise ValueError(f"{self.path} has no committed batch")
        return rows

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One row per key; partial aggregates, so a hot key is a few rows."""
        last = F.max(F.when(F.col("last_alert").isNotNull(), F.struct("last_alert", "message")))
        return rows.groupBy(*self.keys).agg(
            F.min("first_alert").alias("first_alert"), last["last_alert"].alias("last_alert"),
            F.sum("n_alerts").alias("n_alerts"), last["message"].alias("message"))

    def upsert(self, batch: DataFrame, batch_id: int) -> bool:
        """Merge a batch; False if its id has been committed before."""
        now = self.manifest()
        if batch_id <= now["batch"]:
            return False
        new = self._merged(batch.select(
            *self.keys, F.col("alert_ts").alias("first_alert"), F.col("alert_ts").alias("last_alert"),
            F.lit(1).cast("long").alias("n_alerts"), "message")).withColumn("_bucket", self._bucket()).persist()
        try:
            touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # at most ``buckets``
            schema = now["schema"] or json.loads(new.drop("_bucket").schema.json())
            folders = dict(now["folders"])
            if touched:
                old = self._rows(now, touched)
                rows = new.drop("_bucket") if old is None else old.unionByName(new.drop("_bucket"))
                version = f"{self.path}/data/{now['version'] + 1:012d}"
                (self._merged(rows).withColumn("_bucket", self._bucket()).repartition("_bucket")
                 .write.mode("overwrite").partitionBy("_bucket").parquet(version))
                folders |= {str(b): version for b in touched}
            self._commit({"version": now["version"] + 1, "batch": batch_id, "schema": schema, "folders": folders})
        finally:
            new.unpersist()
        return True

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Everything available of a stream of (keys, alert_ts, message)."""
        q = (stream.writeStream.foreachBatch(lambda df, i: self.upsert(df, i) and None)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()
