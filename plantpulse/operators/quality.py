"""Data-quality operators (P2-P14, P19, U3): declarative rules that report
what they reject.

``QualityRules`` replaces the reference's chains of sequential masks (one
copy per mask) by a single pass: every row gets the name of the *first* rule
it fails, which equals the count each sequential mask would have removed.
A full-row dedup step anywhere in the chain is one map-side-combined
aggregation, so even a group of identical copies holding a third of the
table is collapsed before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEDUP = "duplicate"


@dataclass(frozen=True)
class Rule:
    """A named predicate a valid row satisfies. NULL counts as a failure
    (NaN comparisons are false in the reference). ``build`` makes the Column
    lazily so rule sets can be declared at import time."""
    name: str
    build: Callable[[], Column]

    @property
    def passes(self) -> Column:
        return self.build()


def _known(c: str) -> Column:
    """Neither NULL nor NaN (of any type: what is no number is no NaN)."""
    return F.col(c).isNotNull() & ~F.isnan(F.col(c).try_cast("double"))


def not_null(*cols: str, name: str = "null") -> Rule:
    """P3 as a rule: any NULL or NaN in ``cols`` fails."""
    def build() -> Column:
        cond = F.lit(True)
        for c in cols:
            cond = cond & _known(c)
        return cond
    return Rule(name, build)


def in_range(c: str, lo: float | None = None, hi: float | None = None,
             name: str | None = None) -> Rule:
    """Inclusive bounds (either side optional)."""
    def build() -> Column:
        cond = _known(c)
        if lo is not None:
            cond = cond & (F.col(c) >= F.lit(lo))
        if hi is not None:
            cond = cond & (F.col(c) <= F.lit(hi))
        return cond
    return Rule(name or f"{c}_range", build)


def positive(*cols: str, name: str = "positive") -> Rule:
    """Strictly positive (NaN is not)."""
    def build() -> Column:
        cond = F.lit(True)
        for c in cols:
            cond = cond & _known(c) & (F.col(c) > 0)
        return cond
    return Rule(name, build)


def one_of(c: str, values: Sequence, name: str | None = None) -> Rule:
    """Label whitelist."""
    return Rule(name or f"{c}_whitelist", lambda: F.col(c).isin(list(values)))


def predicate(name: str, build: Callable[[], Column]) -> Rule:
    """Any other row predicate (e.g. ``FlowDiff >= 0``)."""
    return Rule(name, build)


@dataclass
class QualityRules:
    """Ordered cleaning chain. ``steps`` holds ``Rule`` objects and at most one
    ``DEDUP`` marker (full-row duplicate removal, keeping one copy)."""
    steps: list = field(default_factory=list)

    def _split(self):
        if self.steps.count(DEDUP) > 1:
            raise ValueError("at most one dedup step")
        j = self.steps.index(DEDUP) if DEDUP in self.steps else None
        before = [s for s in self.steps[: j if j is not None else len(self.steps)]]
        after = [] if j is None else self.steps[j + 1:]
        return before, after, j is not None

    @staticmethod
    def _first_failed(rules: Iterable[Rule]) -> Column:
        whens = [F.when(~F.coalesce(r.passes, F.lit(False)), F.lit(r.name)) for r in rules]
        if not whens:
            return F.lit(None).cast("string")
        return F.coalesce(*whens) if len(whens) > 1 else whens[0]

    def flag(self, df: DataFrame) -> DataFrame:
        """Every input row (or distinct row with ``n_rows`` copies when the
        chain dedups) with ``reject_reason`` (NULL = kept)."""
        before, after, dedup = self._split()
        cols = df.columns
        if not dedup:
            return (df.withColumn("reject_reason", self._first_failed(before))
                      .withColumn("n_rows", F.lit(1).cast("long")))
        g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_pp_n"))
        pre = self._first_failed(before)
        post = self._first_failed(after)
        # a group failing a rule before the dedup is rejected whole by that
        # rule; otherwise one copy goes on to the later rules and the other
        # copies are duplicates
        firsts = g.select(*cols, F.coalesce(pre, post).alias("reject_reason"),
                          F.when(pre.isNotNull(), F.col("_pp_n")).otherwise(F.lit(1))
                           .cast("long").alias("n_rows"))
        extra = (g.filter(pre.isNull() & (F.col("_pp_n") > 1))
                  .select(*cols, F.lit(DEDUP).alias("reject_reason"),
                          (F.col("_pp_n") - 1).alias("n_rows")))
        return firsts.unionByName(extra)

    def apply(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(clean rows, rejected rows with ``reject_reason`` and ``n_rows``)."""
        flagged = self.flag(df)
        clean = flagged.filter(F.col("reject_reason").isNull()).drop("reject_reason", "n_rows")
        rejects = flagged.filter(F.col("reject_reason").isNotNull())
        return clean, rejects

    def report(self, df: DataFrame) -> DataFrame:
        """P6/P11 report: rows removed per step (in chain order, zero rows
        kept) plus ``kept``. One aggregation; ``before`` = sum of all."""
        names = [s.name if isinstance(s, Rule) else DEDUP for s in self.steps] + ["kept"]
        flagged = self.flag(df).withColumn("step", F.coalesce("reject_reason", F.lit("kept")))
        counts = flagged.groupBy("step").agg(F.sum("n_rows").alias("n_rows"))
        order = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
        steps = F.explode(F.array(*[F.lit(n) for n in names])).alias("step")
        dims = df.sparkSession.range(1).select(steps)
        return (dims.join(counts, "step", "left")
                    .select(F.col("step"), F.element_at(order, F.col("step")).alias("step_no"),
                            F.coalesce(F.col("n_rows"), F.lit(0)).cast("long").alias("n_rows")))


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL (and NaN) count per column, one aggregation, unpivoted to
    ``(column, n_null)`` rows."""
    cols = list(cols or df.columns)
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}

    def is_missing(c: str) -> Column:
        m = F.col(c).isNull()
        return (m | F.isnan(c)) if c in floating else m
    agg = df.agg(*[F.count_if(is_missing(c)).alias(c) for c in cols])
    return agg.unpivot([], cols, "column", "n_null")


def drop_any_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``dropna()`` (NaN counts as missing)."""
    return df.na.drop("any", subset=list(cols) if cols else None)


def dedup(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """P10: keep one copy of each full row (partial aggregation map-side)."""
    return df.dropDuplicates(list(cols)) if cols else df.dropDuplicates()


def fill_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL -> column mean over non-NULL values. The means are one
    global aggregate (partial sums per task, one row in the end) used as a
    scalar subquery, so nothing is collected and the plan stays lazy."""
    return df.withColumns({c: F.coalesce(F.col(c), df.agg(F.avg(c)).scalar()) for c in cols})


def sigma_band(df: DataFrame, keys: Sequence[str], col: str, *, k: float = 3.0,
               flag: str = "outlier") -> DataFrame:
    """Per-key mean and population sigma (partial aggregate),
    joined back on the key; ``flag`` is true when ``|x - mu| > k sigma``."""
    from .joins import join_small

    stats = df.groupBy(*keys).agg(F.avg(col).alias("_pp_mu"), F.stddev_pop(col).alias("_pp_sd"))
    out = join_small(df, stats, keys, "left")
    return (out.withColumn(flag, F.abs(F.col(col) - F.col("_pp_mu")) > F.lit(k) * F.col("_pp_sd"))
               .drop("_pp_mu", "_pp_sd"))


def check_contract(df: DataFrame, schema: T.StructType, *, strict_types: bool = False) -> DataFrame:
    """Select the job's columns by name in contract order and cast them;
    fail early when a column is missing (or, if strict, typed differently)."""
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name not in have]
    if missing:
        raise ValueError(f"input is missing columns {missing}")
    if strict_types:
        bad = [f.name for f in schema.fields if have[f.name] != f.dataType]
        if bad:
            raise TypeError(f"columns {bad} do not match the contract types")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def reject_check(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """U3 check: rows in raw but not in clean (multiset difference)."""
    return raw.exceptAll(clean)
