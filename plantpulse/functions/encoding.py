"""Label encode / decode with a literal map (code order, not the
frequency order ``StringIndexer`` would pick). Unknown -> NULL."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import col


def encode_label(c: Column | str, classes: Sequence[str]) -> Column:
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(i)) for i, k in enumerate(classes)))
    return F.try_element_at(m, col(c))


def decode_label(c: Column | str, classes: Sequence[str]) -> Column:
    m = F.create_map(*chain.from_iterable((F.lit(i), F.lit(k)) for i, k in enumerate(classes)))
    return F.try_element_at(m, col(c).cast("int"))
