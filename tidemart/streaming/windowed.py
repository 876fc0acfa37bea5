"""Event-time streaming twins of two live queries.

The reference has no watermark or window at all; these twins compute the
per-minute order counts and stock movements incrementally with a 10-minute
watermark on event time. Rows later than the watermark still reach Bronze
through the topic job but are not counted here. Output mode ``append``:
a minute is emitted once its window can no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import stream_topics as ST
from ..schemas import TOPIC_INVENTORY, TOPIC_ORDER

c = F.col


def _valid_events(raw: DataFrame, topic: str, watermark: str) -> DataFrame:
    parsed = ST.parse(raw, topic).filter(ST.passes_envelope(topic)).withColumn("event_ts", ST.event_ts())
    return (parsed.withWatermark("event_ts", watermark)
                  .dropDuplicatesWithinWatermark(["event_id"]))


def orders_per_minute_stream(raw: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    ev = _valid_events(raw, TOPIC_ORDER, watermark)
    return (ev.groupBy(F.window("event_ts", "1 minute").alias("w"))
              .agg(F.count_if(c("event_type") == "order_created").alias("new_orders"),
                   F.count_if(c("event_type") == "order_cancelled").alias("cancellations"))
              .select(c("w.start").alias("minute"), "new_orders", "cancellations"))


def stock_direction_stream(raw: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    ev = _valid_events(raw, TOPIC_INVENTORY, watermark)
    moves = (ev.select("event_ts", ST.inventory_direction().alias("d"), ST.inventory_quantity_changed().alias("q"))
               .filter(c("d") != 0))
    return (moves.groupBy(F.window("event_ts", "1 minute").alias("w"))
                 .agg(F.sum(F.when(c("d") == 1, c("q")).otherwise(0)).alias("stock_in"),
                      F.sum(F.when(c("d") == -1, -c("q")).otherwise(0)).alias("stock_out"))
                 .select(c("w.start").alias("time_period"), "stock_in", "stock_out"))
