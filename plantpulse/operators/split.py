"""Deterministic splits, folds and class weights.

``randomSplit`` is not stable when the input is repartitioned or a task is
retried on another executor; a hash of the row key is. The hash is
``md5(cast(key as string))`` -- available in DuckDB too, which keeps the
splits oracle-checkable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .joins import null_safe_join


def unit_hash(*keys: str, salt: str = "") -> Column:
    """Uniform value in [0, 1) from the first 32 bits of md5 of the key."""
    parts = [F.col(k).cast("string") for k in keys]
    s = parts[0] if len(parts) == 1 else F.concat_ws("|", *parts)
    if salt:
        s = F.concat(F.lit(salt), s)
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def split_flag(df: DataFrame, keys: Sequence[str], test_fraction: float = 0.2,
               name: str = "is_test", salt: str = "") -> DataFrame:
    """M1: 80/20 split by key hash (no shuffle, stable under retries)."""
    return df.withColumn(name, unit_hash(*keys, salt=salt) < F.lit(test_fraction))


def train_test(df: DataFrame, keys: Sequence[str], test_fraction: float = 0.2,
               salt: str = "") -> tuple[DataFrame, DataFrame]:
    u = unit_hash(*keys, salt=salt)
    return df.filter(u >= test_fraction), df.filter(u < test_fraction)


def stratified_flag(df: DataFrame, keys: Sequence[str], label: str, test_fraction: float = 0.2,
                    name: str = "is_test") -> DataFrame:
    """M2: stratified split. The hash is salted by the label so every class is
    cut at the same fraction independently; no per-class shuffle or ranking,
    so a class holding most rows is never gathered in one task."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(label).cast("string"),
                                             *[F.col(k).cast("string") for k in keys])), 1, 8),
               16, 10).cast("long") / F.lit(4294967296.0)
    return df.withColumn(name, h < F.lit(test_fraction))


#: Buckets of the hash that are counted before a cut is looked for inside one.
CUT_DIGITS = 4


def _struct_lit(row, kind) -> Column:
    """A row of strings from the driver as a column of its type."""
    if row is None:
        return F.lit(None).cast(kind)
    return F.struct(*[F.lit(v).cast("string").alias(f.name) for f, v in zip(kind.fields, row)])


def exact_cuts(df: DataFrame, keys: Sequence[str], ranks, label: str | None = None) -> DataFrame:
    """``df`` with ``_pp_part``, the number of cuts a row lies
    behind, when rows are ordered by md5 of (label and) key. ``ranks`` gives, from
    the column of row counts, the rank behind which each cut falls, per class
    when ``label`` is given (a NULL label is a class).

    No class is sorted: the hash's first digits are counted per class, a running
    sum over those counts names the bucket of each cut, and only rows of that
    bucket are ranked. Rows of one key stay together, so with repeated keys the
    part before a cut can be longer by the repeats of the key at the cut."""
    own = [label] if label else []
    order = F.struct(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in [*own, *keys]])).alias("h"),
                     *[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)])
    x = df.select(*[F.col(c) for c in own], order.alias("_pp_o")).withColumn("_pp_b", F.substring("_pp_o.h", 1, CUT_DIGITS))
    counts = x.groupBy(*own, "_pp_b").agg(F.count(F.lit(1)).alias("_pp_n"))
    along = Window.partitionBy(*own).orderBy("_pp_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_pp_before": F.coalesce(F.sum("_pp_n").over(along), F.lit(0)),
                                 "_pp_all": F.sum("_pp_n").over(Window.partitionBy(*own))})
    wanted = [r.cast("long") for r in ranks(F.col("_pp_all"))]
    cuts = counts.select("*", F.posexplode(F.array(*wanted)).alias("_pp_i", "_pp_rank"))
    cuts = cuts.filter((F.col("_pp_rank") > F.col("_pp_before")) & (F.col("_pp_rank") <= F.col("_pp_before") + F.col("_pp_n")))
    cuts = materialize(cuts.select(*own, "_pp_b", "_pp_i", (F.col("_pp_rank") - F.col("_pp_before")).alias("_pp_rest")), "cuts")
    near = null_safe_join(x, cuts, [*own, "_pp_b"], "inner")
    near = near.withColumn("_pp_rn", F.row_number().over(Window.partitionBy(*own, "_pp_i").orderBy("_pp_o")))
    edges = near.filter(F.col("_pp_rn") == F.col("_pp_rest")).groupBy(*own).agg(
        *[F.max(F.when(F.col("_pp_i") == i, F.col("_pp_o"))).alias(f"_pp_e{i}") for i in range(len(wanted))])
    edges = materialize(edges, "cut-edges")  # a row per class
    marked = df.withColumn("_pp_o", order)
    if own:
        marked = null_safe_join(marked, edges, own, "left")
    else:  # one row of a few edges: literals, no join with every row
        row = edges.first()
        marked = marked.withColumns({f"_pp_e{i}": _struct_lit(row[i], edges.schema[i].dataType) for i in range(len(wanted))})
    behind = [F.coalesce(F.col("_pp_o") > F.col(f"_pp_e{i}"), F.lit(True)).cast("int") for i in range(len(wanted))]
    part = sum(behind[1:], behind[0])
    return marked.withColumn("_pp_part", part).select(*df.columns, "_pp_part")


def exact_split_flag(df: DataFrame, keys: Sequence[str], test_fraction: float = 0.2, label: str | None = None,
                     name: str = "is_test") -> DataFrame:
    """M1 / M2: exactly ``ceil(test_fraction * n)`` test rows, of each class when
    ``label`` is given; a class of one row is for training."""
    def ranks(n):
        need = F.ceil(F.lit(str(test_fraction)).cast("decimal(9,6)") * n)
        return [F.when(n > 1, need).otherwise(0) if label else need]
    out = exact_cuts(df, keys, ranks, label)
    return out.withColumn(name, F.col("_pp_part") == 0).drop("_pp_part")


def exact_fold_id(df: DataFrame, keys: Sequence[str], k: int = 5, label: str | None = None, name: str = "fold") -> DataFrame:
    """Folds of equal size (by one row), also within every class when
    ``label`` is given."""
    out = exact_cuts(df, keys, lambda n: [F.floor(n * i / k) for i in range(1, k)], label)
    return out.withColumnRenamed("_pp_part", name)


def fold_id(df: DataFrame, keys: Sequence[str], k: int = 5, name: str = "fold") -> DataFrame:
    """Fold column for ``CrossValidator(foldCol=...)``."""
    return df.withColumn(name, F.floor(unit_hash(*keys, salt="fold") * k).cast("int"))


def class_weights(df: DataFrame, label: str, *, manual: dict | None = None,
                  name: str = "weight", train: Column | None = None) -> DataFrame:
    """M4: balanced weights ``n / (k * n_c)`` as a column, counted over the
    rows where ``train`` holds (all by default; other classes weigh 1), or a
    manual map. Balanced counts stay in the plan: one aggregate row per class,
    joined back."""
    if manual is not None:
        from itertools import chain

        m = F.create_map(*chain.from_iterable((F.lit(c), F.lit(float(w))) for c, w in manual.items()))
        return df.withColumn(name, F.coalesce(F.try_element_at(m, F.col(label)), F.lit(1.0)))
    from .joins import join_small

    counts = (df if train is None else df.filter(train)).groupBy(label).agg(F.count(F.lit(1)).alias("_pp_n"))
    every = Window.partitionBy()  # over one row per class
    weights = counts.select(label, (F.sum("_pp_n").over(every)
                                    / (F.count(F.lit(1)).over(every) * F.col("_pp_n"))).alias(name))
    return join_small(df, weights, [label]).withColumn(name, F.coalesce(name, F.lit(1.0))).select(*df.columns, name)
