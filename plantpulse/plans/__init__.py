"""Registered queries over the driver tables. Importing this package loads
every plan module so the registry is complete."""

from . import cleaning, evaluation, health, learning, scoring, streams, timeseries  # noqa: F401
from .registry import ORACLES, QUERIES, query  # noqa: F401
