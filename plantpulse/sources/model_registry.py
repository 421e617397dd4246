"""Model registry (M19, S8): versions of a fitted model under one folder.

A version's model is saved into a folder of its own and becomes current when its
manifest is renamed into place; a run that fails before that leaves the current
model as it was. ``challenge`` is the retraining gate: the candidate and the
current model are scored on the same hold-out, and the candidate becomes a new
version when it is no worse.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import SparkSession

from .manifests import Manifests
from .sinks import save_model


class ModelRegistry:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Manifests(spark, path)

    def current(self) -> dict | None:
        """The manifest in force (version, model, metric), None before the first."""
        return self.manifests.newest()

    def load(self, version: int | None = None):
        """The model of a version, by default of the one in force."""
        manifest = self.current() if version is None else self.manifests.get(version)
        if manifest is None:
            raise ValueError(f"{self.path} has no model yet")
        return DefaultParamsReader.loadParamsInstance(manifest["model"], self.spark)

    def _commit(self, model_path: str, metric: float | None) -> int:
        now = self.current()
        version = now["version"] + 1 if now else 1
        self.manifests.commit({"version": version, "model": model_path, "metric": metric})
        return version

    def publish(self, model, metric: float | None = None) -> int:
        """Save the model and put it in force; its version."""
        at = f"{self.path}/models/{uuid.uuid4().hex}"
        save_model(model, at)
        return self._commit(at, metric)

    def rollback(self, version: int) -> int:
        """Put an earlier version's model in force again, as a new version."""
        old = self.manifests.get(version)
        return self._commit(old["model"], old["metric"])

    def challenge(self, candidate, metric: Callable[[object], float], *,
                  larger_is_better: bool = True) -> tuple[float | None, float, bool]:
        """(metric of the current model or None, of the candidate, accepted).
        The first candidate is accepted; later ones when they are no worse, and
        one whose metric is NaN never replaces a model."""
        now = self.current()
        old = metric(self.load()) if now else None
        new = metric(candidate)
        better = old is None or old != old or (new >= old if larger_is_better else new <= old)
        accepted = better and (old is None or new == new)
        if accepted:
            self.publish(candidate, new)
        return old, new, accepted
