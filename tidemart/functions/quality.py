"""Data-quality rules as data: split a frame into good and bad rows.

``split_valid`` guarantees good + bad = input even under three-valued
logic: a rule whose predicate is NULL counts as failed, and every bad row
carries the name of the first rule it failed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written


@dataclass(frozen=True)
class Rule:
    reason: str          # written to quarantine_reason when the rule fails
    check: Column        # TRUE for a good row; NULL is treated as failure


def passes(rules: list[Rule]) -> Column:
    ok = F.lit(True)
    for r in rules:
        ok = ok & F.coalesce(r.check, F.lit(False))
    return ok


def first_failure(rules: list[Rule]) -> Column:
    expr = None
    for r in rules:
        failed = ~F.coalesce(r.check, F.lit(False))
        expr = F.when(failed, F.lit(r.reason)) if expr is None else expr.when(failed, F.lit(r.reason))
    return expr


def split_valid(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(good, bad); bad has an extra ``quarantine_reason`` column.

    Both sides are filters over the same plan; callers that write both
    should persist ``df`` first (or write from a stored layer)."""
    tagged = df.withColumn("_reason", first_failure(rules))
    good = tagged.filter(F.col("_reason").isNull()).drop("_reason")
    bad = tagged.filter(F.col("_reason").isNotNull()).withColumnRenamed("_reason", "quarantine_reason")
    return good, bad


def with_quarantine_stamp(bad: DataFrame, as_of=None) -> DataFrame:
    """Add ``quarantined_at`` (a clock column; dropped before comparisons)."""
    ts = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    return bad.withColumn("quarantined_at", ts)


def dedup_latest(df: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """Keep the newest row per key; ``order`` is most-significant first and
    should end in a total tie-break.

    Written as ``max_by`` over a struct rather than ``row_number`` over a
    window: the aggregate is computed partially on the map side, so a key
    that holds a third of all rows collapses to one row per task before the
    shuffle instead of being sorted in one task."""
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])
    best = F.max_by(F.struct(*[F.col(c) for c in others]), ordering).alias("_row")
    return (df.groupBy(*keys).agg(best)
              .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])
              .select(*df.columns))


#: repeated keys that are broadcast at most
FEW_KEYS = 100_000


def dedup_latest_few(df: DataFrame, key: str, order: list[Column], few: int = FEW_KEYS) -> DataFrame:
    """`dedup_latest` for a large table in which few keys repeat: the keys
    alone are shuffled and counted (a job of its own, so ``df`` should read a
    stored table), then only rows of repeated keys are shuffled whole. With
    more than ``few`` repeated keys all rows are."""
    again = written(df.groupBy(key).count().filter("count > 1").select(F.col(key).alias("_again")), "repeated-keys")
    n = again.count()
    if n == 0:
        return df
    if n > few:
        return dedup_latest(df, key, order)
    same = F.col(key).eqNullSafe(F.col("_again"))
    once = df.join(F.broadcast(again), same, "left_anti")
    return once.unionByName(dedup_latest(df.join(F.broadcast(again), same, "left_semi"), key, order))


def dedup_first(df: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """Keep the oldest row per key (``min_by`` counterpart of dedup_latest)."""
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])
    best = F.min_by(F.struct(*[F.col(c) for c in others]), ordering).alias("_row")
    return (df.groupBy(*keys).agg(best)
              .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])
              .select(*df.columns))
