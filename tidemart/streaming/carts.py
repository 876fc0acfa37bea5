"""Current carts, kept up to date by a stream.

The latest quantity per (session, product) is an aggregate in update mode: its
state is one row a cart line in the engine's store, and a micro-batch hands on
the lines it changed. Those are merged into a table of one row a line, of
which only the touched buckets are rewritten (`segments.upsert`). The latest
event decides, so a repeated or late delivery changes nothing, and neither
does a replayed micro-batch; the table equals `commerce_ops.cart_state` of the
same events.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import stream_topics as ST
from ..schemas import TOPIC_CART
from . import segments
from .runner import _query_id, stream_root, use_state_store

KEYS = ["session_id", "product_id"]


def latest_lines(cart_events: DataFrame) -> DataFrame:
    """(session_id, product_id, quantity, last_event_ts, last): ``last`` orders
    the events of a line."""
    order = F.struct("event_ts", "event_id")
    return cart_events.groupBy(*KEYS).agg(F.max_by("cart_quantity_after", order).alias("quantity"), F.max("event_ts").alias("last_event_ts"), F.max(order).alias("last"))


def carts_path(root: str) -> str:
    return os.path.join(stream_root(root), "state", "carts")


def start_carts(source: DataFrame, root: str, checkpoint_root: str, trigger: dict | None = None, buckets: int = 64) -> StreamingQuery:
    """Keep the cart table below ``root`` up to date with the cart topic."""
    use_state_store(source.sparkSession)
    good = ST.parse(source, TOPIC_CART).filter(ST.passes_envelope(TOPIC_CART))
    _, gold, _ = ST.silver_and_gold(good, TOPIC_CART)
    path = carts_path(root)
    return (latest_lines(gold["fact_cart_events"]).writeStream.queryName("tidemart_carts").outputMode("update")
            .foreachBatch(lambda df, n: segments.upsert(df, path, n, _query_id(df), KEYS, "last", buckets) if not df.isEmpty() else None)
            .option("checkpointLocation", os.path.join(checkpoint_root, "carts"))
            .trigger(**(trigger or {"processingTime": "60 seconds"})).start())


def read_carts(spark: SparkSession, root: str) -> DataFrame:
    return segments.read_keyed(spark, carts_path(root)).drop("last")
