"""Per-topic event processing: parse, validate, dedup, Silver and Gold.

These are plain DataFrame -> DataFrame functions. The streaming job calls
them on each micro-batch inside ``foreachBatch``; the batch queries call
them on a whole static event log. Decisions against the reference:
validation runs before dedup, and only good rows are deduplicated (Q4);
a NULL rule counts as failed, so good + bad = input (Q2); timestamps are
parsed with ``try_cast`` and bad text is quarantined (Q18); out-of-range
review ratings are quarantined rather than silently dropped (Q3).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.apportion import apportion
from ..functions.economics import after_discount, line_economics, unit_margin_pct
from ..functions.quality import Rule, dedup_first, first_failure, passes, split_valid
from ..schemas import (REASON_NULL_EVENT_ID, REASON_NULL_TIMESTAMP, REASON_NULL_USER_ID, REASON_RATING,
                       REASON_UNKNOWN_EVENT_TYPE, TOPIC_CART, TOPIC_INVENTORY, TOPIC_ORDER,
                       TOPIC_PAGE_VIEW, TOPIC_PROMO, TOPIC_REVIEW, TOPIC_SCHEMAS, TOPIC_USER,
                       VALID_EVENT_TYPES)
from .gold import sentiment_label

c = F.col
CORRUPT = "_corrupt_record"
COORDS = ["topic", "partition", "offset", "kafka_timestamp"]


def _t(x):
    return F.trim(c(x)).alias(x)


def _long(x, alias=None):
    return c(x).cast("long").alias(alias or x)


def event_ts():
    return c("timestamp").try_cast("timestamp")


# ---------------------------------------------------------------- parse stage
def parse(raw: DataFrame, topic: str, ingested_at=None) -> DataFrame:
    """from_json with the topic schema; unparsable text lands in
    ``_corrupt_record`` (PERMISSIVE mode) instead of an all-null row.

    The parsed struct is a generator's one row, so rules on its fields filter
    above it: through a projection the optimizer would push them to the scan,
    with the whole text parsed (and built) anew for every field they name."""
    schema = StructType(list(TOPIC_SCHEMAS[topic].fields) + [StructField(CORRUPT, StringType(), True)])
    ts = F.current_timestamp() if ingested_at is None else F.lit(str(ingested_at)).cast("timestamp")
    parsed = F.from_json(c("json_str"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return (raw.select(*COORDS, "json_str", F.inline(F.array(parsed)))
               .select(*schema.names, *COORDS, "json_str")
               .withColumn("ingested_at", ts))


def envelope_rules(topic: str) -> list[Rule]:
    return [
        Rule("unparsable json", c(CORRUPT).isNull()),
        Rule(REASON_NULL_EVENT_ID, c("event_id").isNotNull()),
        Rule(REASON_NULL_TIMESTAMP, c("timestamp").isNotNull()),
        Rule("bad timestamp", event_ts().isNotNull()),
        Rule(REASON_NULL_USER_ID, c("user_id").isNotNull()),
        Rule("null event_type", c("event_type").isNotNull()),
        Rule(REASON_UNKNOWN_EVENT_TYPE, c("event_type").isin(VALID_EVENT_TYPES[topic])),
    ]


def quarantine_frame(bad: DataFrame, topic: str) -> DataFrame:
    return bad.select("event_id", "event_type", "timestamp", "user_id",
                      F.lit(topic).alias("source_topic"), "quarantine_reason",
                      *COORDS, "ingested_at", "json_str")


def dedup_events(good: DataFrame) -> DataFrame:
    """One row per event_id, the first delivered (lowest partition, offset);
    map-side partial aggregation keeps a hot id from landing in one task."""
    return dedup_first(good, "event_id", [c("partition"), c("offset")])


# ------------------------------------------------------------- silver / gold
_TAIL = [*COORDS, "ingested_at"]


def silver_user_events(g):
    return g.select(_t("event_id"), _t("event_type"), event_ts().alias("event_ts"), _t("session_id"),
                    _t("user_id"), _t("user_name"), F.trim(F.lower(c("username"))).alias("username"),
                    _t("gender"), _t("location"), _t("device_type"), _t("os"), *_TAIL)


def fact_user_events(sv):
    return sv.select("event_id", "event_type", "user_id", "username", "gender", "location", "device_type",
                     "os", "session_id", F.to_date("event_ts").alias("date_key"), "event_ts")


def silver_page_view_events(g):
    return g.select(_t("event_id"), _t("event_type"), event_ts().alias("event_ts"), _t("session_id"),
                    _t("user_id"), _t("device_type"), _t("os"), _t("location"), _t("page_name"),
                    _t("product_id"), _t("product_name"), _t("category"), _t("brand"), _long("price"),
                    _t("search_term"), c("results_count").cast("int").alias("results_count"), _t("trigger"),
                    *_TAIL)


def fact_page_views(sv):
    return sv.select("event_id", "event_type", "user_id", "session_id", "device_type", "os", "location",
                     "page_name", "product_id", "product_name", "category", "brand", "price",
                     c("search_term").alias("search_item"), c("results_count").alias("result_count"),
                     "trigger", F.to_date("event_ts").alias("date_key"), "event_ts")


def silver_cart_events(g):
    return g.select(_t("event_id"), _t("event_type"), event_ts().alias("event_ts"), _t("session_id"),
                    _t("user_id"), _t("device_type"), _t("os"), _t("product_id"), _t("product_name"),
                    _t("brand"), _t("category"), _long("unit_price"), _long("quantity"),
                    _long("cart_quantity_after"), _long("old_quantity"), _long("new_quantity"), *_TAIL)


def fact_cart_events(sv):
    et = c("event_type")
    return sv.select("event_id", "event_type", "user_id", "session_id", "device_type", "os", "product_id",
                     "product_name", "brand", "category", "unit_price",
                     F.when(et == "item_added", c("quantity")).when(et == "item_qty_updated", c("new_quantity"))
                      .alias("quantity"),
                     "cart_quantity_after", "old_quantity", "new_quantity",
                     F.to_date("event_ts").alias("date_key"), "event_ts")


def silver_promo_events(g):
    return g.select(_t("event_id"), _t("event_type"), event_ts().alias("event_ts"), _t("session_id"),
                    _t("user_id"), _t("promo_id"), F.upper(F.trim(c("promo_code"))).alias("promo_code"),
                    c("discount_percent").cast("float").alias("discount_percent"), *_TAIL)


def fact_promo_events(sv):
    return sv.select("event_id", "event_type", "user_id", "session_id", "promo_id", "promo_code",
                     "discount_percent", (c("event_type") == "promo_applied").alias("is_applied"),
                     (c("event_type") == "promo_invalid").alias("is_invalid"),
                     F.to_date("event_ts").alias("date_key"), "event_ts")


def silver_order_events(g):
    return g.select(_t("event_id"), _t("event_type"), event_ts().alias("event_ts"), _t("session_id"),
                    _t("user_id"), _t("device_type"), _t("os"), _t("location"), _t("order_id"),
                    _long("subtotal"), _long("shipping_fee"),
                    F.coalesce(c("discount_amount").cast("long"), F.lit(0).cast("long")).alias("discount_amount"),
                    _long("total_amount"), _t("payment_method"), _t("promo_id"),
                    F.upper(F.trim(c("promo_code"))).alias("promo_code"), _t("order_status"), _t("reason"),
                    "items", *_TAIL)


def fact_orders_stream(sv):
    et = c("event_type")
    return sv.select(
        "event_id", "event_type", "order_id", "user_id", "session_id", "device_type", "os", "location",
        "promo_id", "promo_code", "payment_method", "order_status", "subtotal", "shipping_fee",
        "discount_amount", "total_amount",
        F.coalesce(c("total_amount") - c("shipping_fee"), c("total_amount"), F.lit(0).cast("long")).alias("net_revenue"),
        "reason", (et == "order_created").alias("is_new_order"), (et == "order_cancelled").alias("is_cancelled"),
        (et == "order_returned").alias("is_returned"), F.to_date("event_ts").alias("date_key"), "event_ts")


def order_items_explode(sv):
    """order_created rows, one per element of ``items`` (null/empty: none)."""
    return (sv.filter(c("event_type") == "order_created")
              .select("*", F.posexplode("items").alias("i_line", "item"))
              .select("*", c("item.product_id").alias("i_product_id"),
                      c("item.product_name").alias("i_product_name"),
                      c("item.quantity").cast("long").alias("i_quantity"),
                      c("item.unit_price").cast("long").alias("i_unit_price"),
                      c("item.unit_cost").cast("long").alias("i_unit_cost")))


def fact_order_items_stream(ex):
    profit = c("i_unit_price") - c("i_unit_cost")
    return ex.select(
        c("event_id").alias("source_event_id"), "order_id", "user_id", "promo_id", "order_status",
        "payment_method", c("i_product_id").alias("product_id"), c("i_product_name").alias("product_name"),
        c("i_quantity").alias("quantity"), c("i_unit_price").alias("unit_price"),
        c("i_unit_cost").alias("unit_cost"), (c("i_quantity") * c("i_unit_price")).alias("item_total"),
        profit.alias("unit_gross_profit"), (profit * c("i_quantity")).alias("line_gross_profit"),
        unit_margin_pct("i_unit_price", "i_unit_cost").alias("gross_margin_pct"),
        F.to_date("event_ts").alias("date_key"), c("event_ts").alias("order_ts"))


def fact_sales_stream(ex, exact_split: bool = False):
    """One row per order line. ``exact_split``: the lines' discounts add up to
    the order's (largest remainders) instead of being rounded one by one."""
    e = ex.withColumns(line_economics("i_quantity", "i_unit_price", "i_unit_cost", "discount_amount", "subtotal"))
    if exact_split:
        e = e.drop("allocated_discount")
        e = apportion(e, "event_id", "discount_amount", "gross_revenue", "i_line").withColumns(after_discount())
    return e.select(
        c("event_id").alias("source_event_id"), "order_id", "user_id", "promo_id", "promo_code",
        "payment_method", "order_status", c("i_product_id").alias("product_id"),
        c("i_product_name").alias("product_name"), c("i_quantity").alias("quantity"),
        c("i_unit_price").alias("unit_price"), c("i_unit_cost").alias("unit_cost"),
        "gross_revenue", "allocated_discount", "net_revenue", "total_cost", "gross_profit", "gross_margin_pct",
        c("subtotal").alias("order_subtotal"), "shipping_fee",
        c("discount_amount").alias("order_discount_amount"), c("total_amount").alias("order_total_amount"),
        F.to_date("event_ts").alias("date_key"), c("event_ts").alias("order_ts"))


def silver_inventory_events(g):
    return g.select(_t("event_id"), _t("event_type"), event_ts().alias("event_ts"), _t("user_id"),
                    _t("product_id"), _t("product_name"), _t("order_id"), _long("quantity_sold"),
                    _long("quantity_returned"), _long("quantity_added"), _long("stock_remaining"), *_TAIL)


RESTOCK_TYPES = ("restock_manual", "restock_auto")


def inventory_quantity_changed():
    """Units moved by an inventory event, by type (null for alerts)."""
    et = c("event_type")
    return (F.when(et == "stock_updated_out", c("quantity_sold")).when(et == "stock_updated_in", c("quantity_returned"))
             .when(et.isin(*RESTOCK_TYPES), c("quantity_added")).cast("long"))


def inventory_direction():
    """+1 stock in, -1 stock out, 0 otherwise."""
    et = c("event_type")
    return (F.when(et.isin("stock_updated_in", *RESTOCK_TYPES), 1)
             .when(et == "stock_updated_out", -1).otherwise(0))


def fact_inventory_events(sv):
    et = c("event_type")
    return sv.select(
        "event_id", "event_type", "product_id", "product_name", "order_id",
        inventory_quantity_changed().alias("quantity_changed"), inventory_direction().alias("stock_direction"),
        "stock_remaining", (et == "low_stock_alert").alias("is_alert"), et.isin(*RESTOCK_TYPES).alias("is_restock"),
        F.to_date("event_ts").alias("date_key"), "event_ts")


def silver_review_events(g):
    return g.select(_t("event_id"), _t("event_type"), event_ts().alias("event_ts"), _t("user_id"),
                    _t("product_id"), c("rating").cast("int").alias("rating"),
                    c("comment_length").cast("int").alias("comment_length"), *_TAIL)


def fact_review_events(sv):
    return sv.select("event_id", "event_type", "user_id", "product_id", "rating",
                     sentiment_label("rating").alias("sentiment_label"), "comment_length",
                     (F.coalesce(c("comment_length"), F.lit(0)) > 0).alias("has_comment"),
                     F.to_date("event_ts").alias("date_key"), "event_ts")


# ------------------------------------------------------------------ registry
@dataclass
class TopicSpec:
    topic: str
    silver_table: str
    silver: Callable[[DataFrame], DataFrame]
    gold: dict[str, Callable[[DataFrame], DataFrame]]
    extra_rules: Callable[[], list[Rule]] = lambda: []
    exploded_gold: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    @property
    def gold_tables(self) -> list[str]:
        return list(self.gold) + list(self.exploded_gold)


TOPICS = {
    TOPIC_USER: TopicSpec(TOPIC_USER, "user_events", silver_user_events, {"fact_user_events": fact_user_events}),
    TOPIC_PAGE_VIEW: TopicSpec(TOPIC_PAGE_VIEW, "page_view_events", silver_page_view_events,
                               {"fact_page_views": fact_page_views}),
    TOPIC_CART: TopicSpec(TOPIC_CART, "cart_events", silver_cart_events, {"fact_cart_events": fact_cart_events}),
    TOPIC_PROMO: TopicSpec(TOPIC_PROMO, "promo_events", silver_promo_events,
                           {"fact_promo_events": fact_promo_events}),
    TOPIC_ORDER: TopicSpec(TOPIC_ORDER, "order_events", silver_order_events,
                           {"fact_orders_stream": fact_orders_stream},
                           exploded_gold={"fact_order_items_stream": fact_order_items_stream,
                                          "fact_sales_stream": fact_sales_stream}),
    TOPIC_INVENTORY: TopicSpec(TOPIC_INVENTORY, "inventory_events", silver_inventory_events,
                               {"fact_inventory_events": fact_inventory_events}),
    TOPIC_REVIEW: TopicSpec(TOPIC_REVIEW, "review_events", silver_review_events,
                            {"fact_review_events": fact_review_events},
                            extra_rules=lambda: [Rule(REASON_RATING, c("rating").between(1, 5))]),
}


@dataclass
class TopicFrames:
    quarantine: DataFrame
    silver: DataFrame
    gold: dict[str, DataFrame]
    exploded: DataFrame | None = None


def passes_envelope(topic: str):
    """TRUE when a parsed row passes every rule of its topic."""
    return passes(envelope_rules(topic) + TOPICS[topic].extra_rules())


def quality_reason(topic: str):
    """Name of the first rule a parsed row fails, NULL for a good row."""
    return first_failure(envelope_rules(topic) + TOPICS[topic].extra_rules())


def split_topic(parsed: DataFrame, topic: str) -> tuple[DataFrame, DataFrame]:
    spec = TOPICS[topic]
    good, bad = split_valid(parsed, envelope_rules(topic) + spec.extra_rules())
    return dedup_events(good), quarantine_frame(bad, topic)


def rejected(parsed: DataFrame, topic: str) -> DataFrame:
    """The quarantine rows of a parsed frame."""
    return quarantine_frame(split_valid(parsed, envelope_rules(topic) + TOPICS[topic].extra_rules())[1], topic)


def silver_and_gold(good: DataFrame, topic: str) -> tuple[DataFrame, dict[str, DataFrame], DataFrame | None]:
    spec = TOPICS[topic]
    sv = spec.silver(good)
    gold = {name: fn(sv) for name, fn in spec.gold.items()}
    ex = None
    if spec.exploded_gold:
        ex = order_items_explode(sv)
        gold.update({name: fn(ex) for name, fn in spec.exploded_gold.items()})
    return sv, gold, ex


def silver_and_gold_from_silver(sv: DataFrame, topic: str):
    """Gold of a topic from its (stored) Silver table."""
    spec = TOPICS[topic]
    gold = {name: fn(sv) for name, fn in spec.gold.items()}
    ex = None
    if spec.exploded_gold:
        ex = order_items_explode(sv)
        gold.update({name: fn(ex) for name, fn in spec.exploded_gold.items()})
    return sv, gold, ex


def process_static(raw: DataFrame, topic: str, ingested_at=None) -> TopicFrames:
    """All layers of one topic from a static raw log (all topics mixed)."""
    parsed = parse(raw.filter(c("topic") == topic), topic, ingested_at)
    good, bad = split_topic(parsed, topic)
    sv, gold, ex = silver_and_gold(good, topic)
    return TopicFrames(bad, sv, gold, ex)
