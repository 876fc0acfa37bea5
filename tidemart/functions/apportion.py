"""Exact apportionment of an amount over lines.

Rounding each line's share by itself leaves an order's lines a few units off
its discount. Largest remainders don't: every line gets the floor of its
share, and the units left over go one each to the lines with the largest
remainders, ties to the smaller ``tie``. So the parts add up exactly.

Ranking remainders needs all lines of a key, which one task can't hold for a
key of any size. Keys of up to ``HOT_LINES`` lines are ranked by one window.
Lines of larger keys are ranked by counts instead: lines of one remainder are
counted (partial sums in each task), remainders are dealt to as many buckets
as the key needs, whose counts say how many lines come before each bucket; so
each remainder is known to win for all of its lines, for none, or, for one
remainder a key, for some, and those are ranked by ``tie`` in buckets alike.
Nothing there gathers more than a bucket, or one row a bucket of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .money import SAFE_FACTOR, idiv

c = F.col
HOT_LINES, BUCKET_LINES = 100_000, 1_000


def _share(amount: Column, weight: Column, total: Column) -> tuple[Column, Column]:
    """(floor, remainder) of amount * weight / total, all LONG and not
    negative: in LONG where the product fits, else in DECIMAL(38,0)."""
    small = (amount < SAFE_FACTOR) & (weight < SAFE_FACTOR)
    wide = (amount.cast("decimal(19,0)") * weight.cast("decimal(19,0)")).cast("decimal(38,0)")
    whole = F.when(small, idiv(amount * weight, total)).otherwise(idiv(wide, total.cast("decimal(19,0)")))
    rest = F.when(small, amount * weight % total).otherwise((wide % total.cast("decimal(19,0)")).cast("long"))
    return whole, rest


def apportion(lines: DataFrame, key: str, amount: str, weight: str, tie: str, out: str = "allocated_discount",
              hot_lines: int = HOT_LINES, bucket_lines: int = BUCKET_LINES) -> DataFrame:
    """``lines`` with ``out``: each line's part of its key's ``amount``, by
    weight. ``tie`` is a number that differs within a key. Parts add up to the
    amount wherever the key's weights have a positive sum; else they are 0.
    Null amounts and weights and negative weights count as 0; a negative
    amount is split like its opposite. Lines without a key get 0."""
    zero = F.lit(0).cast("long")
    named = {n: f"__{n}" + "_" * max(map(len, lines.columns)) for n in ("w", "t", "n", "a", "base", "r", "extra")}
    w, t, n, a, base, r, extra = (named[x] for x in ("w", "t", "n", "a", "base", "r", "extra"))
    x = lines.withColumns({w: F.greatest(F.coalesce(c(weight).cast("long"), zero), zero), a: F.abs(F.coalesce(c(amount).cast("long"), zero))})

    def split(j: DataFrame) -> DataFrame:
        floor, rest = _share(c(a), c(w), c(t))
        counts = c(key).isNotNull() & (c(t) > 0)
        return j.withColumns({base: F.when(counts, floor).otherwise(zero), r: F.when(counts, rest).otherwise(zero)})

    # keys of too many lines for a window, with their sums: few, and mostly none
    large = x.filter(c(key).isNotNull()).groupBy(key).agg(F.sum(w).alias(t), F.count(F.lit(1)).alias(n)).filter((c(n) > hot_lines) & (c(t) > 0))
    large = written(large, "large-keys")
    any_hot = not large.isEmpty()

    # one window holds a key's lines; lines without a key are dealt by themselves
    alone = F.when(c(key).isNull(), F.xxhash64(tie))
    of_key = Window.partitionBy(key, alone)
    cold = split((x.join(large, key, "left_anti") if any_hot else x).withColumn(t, F.sum(w).over(of_key)))
    units = F.when(c(key).isNotNull() & (c(t) > 0), c(a) - F.sum(base).over(of_key)).otherwise(zero)
    place = F.row_number().over(of_key.orderBy(c(r).desc(), c(tie)))
    whole = cold.withColumn(extra, (place <= units).cast("long"))
    if any_hot:      # the counted path reads the lines several times: only where a key needs it
        hot = split(x.join(large, key))
        whole = whole.withColumn(n, zero).unionByName(_rank_hot(hot, key, a, t, n, base, r, tie, extra, bucket_lines))
    part = F.signum(F.coalesce(c(amount), zero)).cast("long") * (c(base) + c(extra))
    return whole.withColumn(out, part).drop(*named.values())


def _rank_hot(hot: DataFrame, key: str, a: str, t: str, n: str, base: str, r: str, tie: str, extra: str, bucket_lines: int) -> DataFrame:
    """Lines of large keys with ``extra`` (0 or 1)."""
    per_r = hot.groupBy(key, r).agg(F.count(F.lit(1)).alias("__m"), F.sum(base).alias("__b"), F.max(a).alias("__a"), F.max(t).alias("__t"), F.max(n).alias("__n"))
    units = per_r.groupBy(key).agg((F.max("__a") - F.sum("__b")).alias("__units"))
    k = F.greatest(idiv(c("__n"), bucket_lines), F.lit(1).cast("long"))
    per_r = per_r.withColumn("__bucket", k - 1 - F.floor(c(r).cast("double") / c("__t").cast("double") * k.cast("double")).cast("long"))
    upto = Window.partitionBy(key).orderBy("__bucket")
    before = per_r.groupBy(key, "__bucket").agg(F.sum("__m").alias("__lines")).withColumn("__before", F.sum("__lines").over(upto) - c("__lines")).drop("__lines")
    inside = Window.partitionBy(key, "__bucket").orderBy(c(r).desc())
    wins = per_r.withColumn("__above", F.sum("__m").over(inside) - c("__m")).join(before, [key, "__bucket"]).join(units, key)
    left = c("__units") - c("__before") - c("__above")
    wins = wins.select(key, r, "__m", F.greatest(F.least(left, c("__m")), F.lit(0).cast("long")).alias("__take"))
    j = hot.join(wins, [key, r])
    some = (c("__take") > 0) & (c("__take") < c("__m"))
    sure = j.filter(~some).withColumn(extra, (c("__take") > 0).cast("long"))
    tied = j.filter(some).withColumn("__bucket", idiv(c(tie), bucket_lines))
    counts = tied.groupBy(key, "__bucket").agg(F.count(F.lit(1)).alias("__lines"))
    counts = counts.withColumn("__before", F.sum("__lines").over(upto) - c("__lines")).drop("__lines")
    tied = tied.join(counts, [key, "__bucket"])
    place = c("__before") + F.row_number().over(Window.partitionBy(key, "__bucket").orderBy(tie))
    tied = tied.withColumn(extra, (place <= c("__take")).cast("long"))
    return sure.drop("__m", "__take").unionByName(tied.drop("__m", "__take", "__bucket", "__before"))
