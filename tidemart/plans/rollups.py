"""Live KPIs from minute rollups.

A rollup row holds a minute's exact sums and a mergeable sketch of the users
that logged in. Rows of one minute may be many (one a micro-batch): sums add
up and sketches merge, so rollups are appended as batches arrive and never
read back to be changed. A window is its whole minutes, from the rollups, and
the part of a minute it begins in, rolled up from the facts of that minute
alone: exact figures equal those of `live.stream_kpis` for any window, and the
number of users is the sketch's, within `USERS_WITHIN` of the true one (four
standard errors of 2^-6 * 1.04). A dashboard reads minutes instead of events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefilter import as_of_ts
from ..oracle.sql import with_ctes
from ..registry import ORACLES, lake, register
from ..session import scratch_path, written
from ..streaming import segments
from . import live

c = F.col
SKETCH_BITS, USERS_WITHIN = 12, 0.065
SUMS = ["new_orders", "cancellations", "returns", "paid_orders", "live_revenue", "page_views", "cart_adds"]
FACTS = ["fact_orders_stream", "fact_sales_stream", "fact_user_events", "fact_page_views", "fact_cart_events"]
_TIME = {"fact_sales_stream": "order_ts"}


def _figures(fact: str) -> dict[str, Column]:
    """What a row of a fact adds to each sum; ``user`` is who logged in."""
    one = lambda cond: cond.cast("long")
    return {
        "fact_orders_stream": {"new_orders": one(c("is_new_order")), "cancellations": one(c("is_cancelled")), "returns": one(c("is_returned")), "paid_orders": one(c("event_type") == "order_paid")},
        "fact_sales_stream": {"live_revenue": c("net_revenue")},
        "fact_user_events": {"user": F.when(c("event_type") == "user_login", c("user_id"))},
        "fact_page_views": {"page_views": F.lit(1).cast("long")},
        "fact_cart_events": {"cart_adds": one(c("event_type") == "item_added")},
    }[fact]


def rollups(facts: dict[str, DataFrame]) -> DataFrame:
    """(date_key, minute, sums..., users sketch) of some facts, whole tables or
    one micro-batch of them; one aggregate over their union."""
    whole = None
    for name, df in facts.items():
        made = _figures(name)
        at = c(_TIME.get(name, "event_ts"))
        part = df.select(F.date_trunc("minute", at).alias("minute"), *[made.get(k, F.lit(None).cast("long")).alias(k) for k in SUMS], made.get("user", F.lit(None).cast("string")).alias("user"))
        whole = part if whole is None else whole.unionByName(part)
    out = whole.groupBy("minute").agg(*[F.sum(k).alias(k) for k in SUMS], F.hll_sketch_agg("user", SKETCH_BITS).alias("users"))
    return out.select(F.to_date("minute").alias("date_key"), "minute", *SUMS, "users")


def kpis(minutes: DataFrame, facts: dict[str, DataFrame], hours: int, as_of=None) -> DataFrame:
    """The columns of `live.stream_kpis` for the last ``hours``; active_users
    is an estimate."""
    start = as_of_ts(as_of) - F.make_interval(hours=F.lit(int(hours)))
    first = F.date_trunc("minute", start)
    whole = minutes.filter((c("date_key") >= F.to_date(first)) & (c("minute") > first))
    edge = {}
    for name, df in facts.items():
        at = c(_TIME.get(name, "event_ts"))
        edge[name] = df.filter((at >= start) & (at < first + F.expr("INTERVAL 1 MINUTE")) & (c("date_key") == F.to_date(first)))
    u = whole.unionByName(rollups(edge))
    agg = u.agg(*[F.sum(k).alias(k) for k in SUMS], F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("users", F.lit(False))), F.lit(0)).cast("long").alias("active_users"))
    zero = F.lit(0).cast("long")
    agg = agg.withColumns({k: F.coalesce(c(k), zero) for k in SUMS if k != "live_revenue"})
    agg = agg.withColumn("conversion_rate", F.try_divide(c("new_orders"), F.nullif(c("cart_adds"), F.lit(0))))
    return agg.select("new_orders", "cancellations", "returns", "paid_orders", "live_revenue", "active_users", "page_views", "cart_adds", "conversion_rate")


def add_batch(spark, path: str, facts: dict[str, DataFrame], batch_id: int, run_id: str = "run") -> int:
    """Append the rollups of one micro-batch (a replay adds nothing)."""
    return segments.append(rollups(facts), path, batch_id, run_id, by="date_key")


def read_minutes(spark, path: str) -> DataFrame:
    return segments.read(spark, path).drop("run_id", "batch_id")


# ------------------------------------------------------------ registration
_ORDER_COLS = ["is_new_order", "is_cancelled", "is_returned", "event_type"]
_READ = {"fact_orders_stream": _ORDER_COLS, "fact_sales_stream": ["net_revenue"], "fact_user_events": ["event_type", "user_id"],
         "fact_page_views": [], "fact_cart_events": ["event_type"]}


def _stored_facts(spark, d) -> dict[str, DataFrame]:
    """The facts' columns that the KPIs read, by id first; written once, as
    rollups, the window's edge and the exact figures each read them."""
    tables = {n: lake(spark, d).table(n) for n in FACTS}
    return {n: written(df.select(df.columns[0], *_READ[n], _TIME.get(n, "event_ts"), "date_key"), n) for n, df in tables.items()}


def _stored_minutes(spark, facts: dict[str, DataFrame]) -> DataFrame:
    """Rollups appended in three batches of the log, as a stream would."""
    path = scratch_path(spark, f"kpi-minutes-{live.dt.datetime.now().timestamp():.6f}")
    for k in range(3):
        add_batch(spark, path, {n: df.filter(F.pmod(F.crc32(df.columns[0]), F.lit(3)) == k) for n, df in facts.items()}, k)
    return read_minutes(spark, path)


def _register(suffix: str, hours: int, as_of) -> None:
    exact = ORACLES["stream_kpis" + suffix]

    def run(spark, d):
        facts = _stored_facts(spark, d)
        found = kpis(_stored_minutes(spark, facts), facts, hours, as_of)
        true = live.stream_kpis(*facts.values(), hours=hours, as_of=as_of).select(c("active_users").alias("true_users"))
        both = found.unionByName(true, allowMissingColumns=True)        # one row each
        both = both.agg(*[F.max(k).alias(k) for k in both.columns])
        near = F.abs(c("active_users") - c("true_users")) <= F.ceil(F.lit(USERS_WITHIN) * c("true_users"))
        return both.withColumn("users_within", near).drop("active_users", "true_users")

    register("stream_kpis_rollup" + suffix, f"SELECT * EXCLUDE (active_users), true AS users_within FROM ({exact})")(run)


_register("", live.HOURS, live.EVENTS_AS_OF)
_register("_6h", live.FEW_HOURS, live.INSIDE)
