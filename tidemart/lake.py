"""``Lake``: every layer of one data folder as lazily built DataFrames.

A Lake is a plan factory, not a cache: ``lake.table("fact_sales")`` returns
the DataFrame whose plan reads the source tables and applies Bronze,
Silver and Gold. ``Lake.from_stored(...)`` reads layers that a batch run
wrote instead (SURVEY Q14: each layer reads the stored previous layer).
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import bronze as B
from .operators import gold as G
from .operators import silver as S
from .operators import stream_topics as ST
from .sources import adapters as A
from .sources.events import raw_event_log
from .streaming import segments

# Default clocks of the test data (orders end 2001-08-01, events 2024-01-30).
ORDERS_AS_OF = dt.datetime(2001, 8, 2)
EVENTS_AS_OF = dt.datetime(2024, 1, 31)
FIXED_BATCH_ID = "20010802_000000"
FACT_MONTH = "date_month"   # partition column of stored facts: first day of date_key's month

GOLD_TABLES = ["dim_date", "dim_users", "dim_products", "dim_promotions", "dim_payment_method",
               "dim_order_status", "fact_orders", "fact_order_items", "fact_sales",
               "fact_inventory_log", "fact_reviews"]
STREAM_GOLD_TABLES = ["fact_user_events", "fact_page_views", "fact_cart_events", "fact_promo_events",
                      "fact_orders_stream", "fact_order_items_stream", "fact_sales_stream",
                      "fact_inventory_events", "fact_review_events"]


class Lake:
    def __init__(self, spark: SparkSession, sf_dir: str | None = None,
                 as_of: dt.datetime = ORDERS_AS_OF, events_as_of: dt.datetime = EVENTS_AS_OF,
                 batch_id: str = FIXED_BATCH_ID, stored: str | None = None):
        self.spark, self.sf_dir = spark, sf_dir
        self.as_of, self.events_as_of, self.batch_id = as_of, events_as_of, batch_id
        self.stored = stored
        self.src = A.Sources(spark, sf_dir) if sf_dir else None
        self._memo: dict[str, DataFrame] = {}

    @classmethod
    def from_stored(cls, spark: SparkSession, root: str, **kw) -> "Lake":
        return cls(spark, None, stored=root, **kw)

    # -------------------------------------------------------------- layers
    def raw(self, name: str) -> DataFrame:
        return self.src.t(name)

    def bronze(self, entity: str) -> DataFrame:
        df = self.src.entity(entity)
        if entity == "users":
            return B.bronze_users(df, self.batch_id, self.as_of)
        return B.bronze_snapshot(df, entity, self.batch_id, self.as_of)

    def raw_events(self) -> DataFrame:
        return self._get("raw_events", lambda: raw_event_log(self.src.t("events")))

    def _read(self, *parts: str) -> DataFrame:
        return self._stored(*parts).drop("dw_loaded_at", "dw_updated_at", "quarantined_at", "run_id", FACT_MONTH)

    def _stored(self, *parts: str) -> DataFrame:
        """A stored table: plain Parquet of a batch run, or the segments of
        the streaming job (without their batch number)."""
        path = os.path.join(self.stored, *parts)
        if segments.is_table(self.spark, path):
            return segments.read(self.spark, path).drop("run_id", "batch_id")
        return self.spark.read.parquet(path)

    def table_since(self, name: str, days: int, as_of: dt.datetime | None = None) -> DataFrame:
        """A fact for queries about the last ``days``: stored facts are
        pruned to the months that can hold such rows."""
        if not self.stored:
            return self.table(name)
        df = self._stored("gold", name)
        if FACT_MONTH in df.columns:
            first = ((as_of or dt.datetime.now()) - dt.timedelta(days=days)).date().replace(day=1)
            df = df.filter(F.col(FACT_MONTH) >= F.lit(first))
        return df.drop("dw_loaded_at", "dw_updated_at", "run_id", FACT_MONTH)

    def silver(self, entity: str) -> DataFrame:
        if self.stored:
            return self._get(f"silver_{entity}", lambda: self._read("silver", entity))
        return self._get(f"silver_{entity}", lambda: S.silver(entity, self.bronze(entity))[0])

    def quarantine(self, entity: str) -> DataFrame:
        if self.stored:
            return self._get(f"quarantine_{entity}", lambda: self._read("quarantine", entity))
        return self._get(f"quarantine_{entity}", lambda: S.split_valid(self.bronze(entity), S.rules(entity))[1])

    def topic(self, topic: str) -> ST.TopicFrames:
        if self.stored:
            return self._get(f"topic_{topic}", lambda: self._stored_topic(topic))
        return self._get(f"topic_{topic}", lambda: ST.process_static(self.raw_events(), topic,
                                                                      ingested_at=self.events_as_of))

    def _stored_topic(self, topic: str) -> ST.TopicFrames:
        spec = ST.TOPICS[topic]
        sv = self._read("silver", spec.silver_table)
        gold = {n: self._read("gold", n) for n in spec.gold_tables}
        ex = ST.order_items_explode(sv) if spec.exploded_gold else None
        return ST.TopicFrames(self._read("quarantine", "events", topic.replace(".", "_")), sv, gold, ex)

    def table(self, name: str) -> DataFrame:
        if self.stored:
            return self._get(name, lambda: self._read("gold", name))
        return self._get(name, lambda: self.build_gold(name))

    def build_gold(self, name: str) -> DataFrame:
        sp, s = self.spark, self.silver
        builders = {
            "dim_date": lambda: G.dim_date_spanning(G.date_span(
                (self.src.t("orders"), "o_orderdate"), (self.src.t("events"), "ts"))),
            "dim_users": lambda: G.dim_users(s("users"), self.as_of),
            "dim_products": lambda: G.dim_products(s("products"), s("inventory")),
            "dim_promotions": lambda: G.dim_promotions(s("promotions")),
            "dim_payment_method": lambda: G.dim_payment_method(sp),
            "dim_order_status": lambda: G.dim_order_status(sp),
            "fact_orders": lambda: G.fact_orders(s("orders")),
            "fact_order_items": lambda: G.fact_order_items(s("order_items"), s("orders")),
            "fact_sales": lambda: G.fact_sales(s("order_items"), s("orders"), s("products")),
            "fact_inventory_log": lambda: G.fact_inventory_log(s("inventory_logs")),
            "fact_reviews": lambda: G.fact_reviews(s("reviews")),
        }
        if name in builders:
            return builders[name]()
        for t in ST.TOPICS.values():
            if name in t.gold_tables:
                return self.topic(t.topic).gold[name]
        raise KeyError(name)

    def _get(self, key, fn):
        if key not in self._memo:
            self._memo[key] = fn()
        return self._memo[key]
