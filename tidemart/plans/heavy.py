"""Top lists from hourly summaries (SURVEY §2.8 ``trending_searches``,
``top_viewed_products``), exact by proof.

An hour's summary keeps its ``KEEP`` commonest items with their counts, and
how often the next one occurs (``rest``). Summaries are merged by adding: an
item that no hour kept occurs at most as often as the hours' rests together.
A window's candidates are the items its hours kept; they are counted exactly
from the facts. If the last of the top list occurs more often than the rests
together, no other item can be in it: the list is proven. Else (many items
about as common) all items of the window are counted.

Counting candidates groups and shuffles their rows only; the summaries are
small, and a stored hour is never computed again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefilter import as_of_ts, recent
from ..registry import ORACLES, lake, register
from ..session import scratch_path
from ..sources.io import write_table
from . import live

c = F.col
KEEP = 64


def summaries(events: DataFrame, item: str, ts: str = "event_ts", keep: int = KEEP) -> DataFrame:
    """(date_key, hour, item, n, rest): the kept items of each hour. Items are
    counted before they are ranked, so an hour's window holds its items, not
    its events, of which each task passes on ``keep`` + 1."""
    counts = events.filter(c(item).isNotNull()).groupBy(F.date_trunc("hour", ts).alias("hour"), c(item).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("hour").orderBy(c("n").desc(), "item")
    ranked = counts.withColumn("place", F.row_number().over(w)).filter(c("place") <= keep + 1)
    rest = F.max(F.when(c("place") == keep + 1, c("n"))).over(Window.partitionBy("hour"))
    out = ranked.withColumn("rest", F.coalesce(rest, F.lit(0).cast("long"))).filter(c("place") <= keep)
    return out.select(F.to_date("hour").alias("date_key"), "hour", "item", "n", "rest")


def top_items(stored: DataFrame, events: DataFrame, item: str, hours: int, limit: int, as_of=None, ts: str = "event_ts") -> tuple[DataFrame, bool]:
    """((item, n), proven): the ``limit`` commonest items of the last
    ``hours``, ties by the item; ``proven`` says whether the candidates
    sufficed or all items were counted."""
    start = as_of_ts(as_of) - F.make_interval(hours=F.lit(int(hours)))
    first = F.date_trunc("hour", start)                       # an hour begun before the window may hold more, never less
    window = stored.filter((c("hour") >= first) & (c("date_key") >= F.to_date(first)))
    bound = window.groupBy("hour").agg(F.max("rest").alias("rest")).agg(F.coalesce(F.sum("rest"), F.lit(0))).first()[0]
    rows = recent(events.filter(c(item).isNotNull()), ts, hours, as_of).select(c(item).alias("item"))
    among = rows.join(window.select("item").distinct(), "item", "left_semi")

    def counted(df: DataFrame) -> DataFrame:
        return df.groupBy("item").agg(F.count(F.lit(1)).alias("n")).orderBy(c("n").desc(), "item").limit(limit)

    top = counted(among).collect()                            # `limit` rows
    proven = bound == 0 or (len(top) == limit and top[-1]["n"] > bound)
    if proven:
        return events.sparkSession.createDataFrame([(r["item"], r["n"]) for r in top], f"item {events.schema[item].dataType.simpleString()}, n long"), True
    return counted(rows), False


def top_viewed(stored: DataFrame, views: DataFrame, hours: int, limit: int = 10, as_of=None) -> DataFrame:
    """`live.top_viewed_products`, whose distinct viewers are then counted for
    the products in the list alone. ``stored``: summaries of `viewed`."""
    shown = viewed(views)
    top, _ = top_items(stored, shown, "shown", hours, limit, as_of)
    return live.top_viewed_products(shown.join(top.select(c("item").alias("shown")), "shown", "left_semi"), hours, limit, as_of)


def viewed(views: DataFrame) -> DataFrame:
    """Product views with the (name, category) pair as one item."""
    known = views.filter((c("event_type") == "product_viewed") & c("product_name").isNotNull())
    return known.withColumn("shown", F.struct("product_name", "category"))


# ------------------------------------------------------------ registration
def _stored(spark, events: DataFrame, item: str, keep: int) -> DataFrame:
    path = scratch_path(spark, f"hourly-{item}-{uuid.uuid4().hex}")
    write_table(summaries(events, item, keep=keep), path, partition_by=["date_key"])
    return spark.read.parquet(path)


def _views(spark, d, kind: str) -> DataFrame:
    return lake(spark, d).table("fact_page_views").filter(c("event_type") == kind)


for _suffix, (_hours, _as_of) in live.WINDOWS.items():
    register("trending_searches_from_summaries" + _suffix, ORACLES["trending_searches" + _suffix])(
        lambda spark, d, h=_hours, a=_as_of: (lambda e: top_items(_stored(spark, e, "search_item", KEEP), e, "search_item", h, 8, a)[0]
                                              .select(c("item").alias("search_item"), c("n").alias("search_count")))(_views(spark, d, "search_performed")))
    register("top_viewed_from_summaries" + _suffix, ORACLES["top_viewed_products" + _suffix])(
        lambda spark, d, h=_hours, a=_as_of: (lambda v: top_viewed(_stored(spark, viewed(v), "shown", KEEP), v, h, 10, a))(lake(spark, d).table("fact_page_views")))
