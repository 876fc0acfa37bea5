"""The test ``events`` table as a raw multi-topic event log.

Each row becomes one JSON message on one of the seven topics, with the
envelope and payload fields the topic schemas declare, exactly like a
producer would serialise it (``to_json(named_struct(...))``). The result
has the Kafka source's shape: topic, partition, offset, kafka_timestamp,
json_str, so the same parsing code runs on it and on a live topic.

Routing (all by key arithmetic, mirrored in the DuckDB oracle):
  signup -> user; view -> page_view, or review when event_id % 5 = 0;
  click -> cart, or promo when % 5 = 0; purchase -> order, or inventory
  when % 5 = 0; error -> topic (event_id % 7), carrying one reject kind
  ((event_id div 7) % 7): null event_id, null timestamp, bad timestamp,
  null user_id, null event_type, unknown type, unparsable text.
Every 50th event is delivered twice (at-least-once delivery).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import ALL_TOPICS, VALID_EVENT_TYPES

_TOPIC_CASE = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(ALL_TOPICS))
_FIRST_TYPE_CASE = " ".join(f"WHEN '{t}' THEN '{VALID_EVENT_TYPES[t][0]}'" for t in ALL_TOPICS)

# Derived columns, in dependency order (Spark SQL expressions).
_STEPS = [
    ("k", "cast(get_json_object(props, '$.k') as int)"),
    ("eid", "event_id"),
    ("uid", "user_id"),
    ("base_price", "cast(round(value * 100) as bigint) * 1000"),
    ("topic", f"""CASE event_type
        WHEN 'signup' THEN 'ecommerce.user'
        WHEN 'view' THEN IF(eid % 5 = 0, 'ecommerce.review', 'ecommerce.page_view')
        WHEN 'click' THEN IF(eid % 5 = 0, 'ecommerce.promo', 'ecommerce.cart')
        WHEN 'purchase' THEN IF(eid % 5 = 0, 'ecommerce.inventory', 'ecommerce.order')
        ELSE CASE cast(eid % 7 as int) {_TOPIC_CASE} END END"""),
    ("reject", "IF(event_type = 'error', cast((eid div 7) % 7 as int), -1)"),
    ("etype", f"""CASE WHEN event_type = 'error' THEN CASE topic {_FIRST_TYPE_CASE} END
        WHEN topic = 'ecommerce.user' THEN element_at(array('user_registered', 'user_login',
             'user_logout', 'user_login_attempt', 'user_login_failed'), cast(eid % 5 as int) + 1)
        WHEN topic = 'ecommerce.page_view' THEN element_at(array('page_viewed', 'product_viewed',
             'search_performed', 'category_filtered'), cast(eid % 4 as int) + 1)
        WHEN topic = 'ecommerce.cart' THEN element_at(array('item_added', 'item_qty_updated',
             'item_removed'), cast(eid % 3 as int) + 1)
        WHEN topic = 'ecommerce.promo' THEN element_at(array('promo_applied', 'promo_removed',
             'promo_invalid'), cast((eid div 5) % 3 as int) + 1)
        WHEN topic = 'ecommerce.order' THEN CASE WHEN eid % 10 IN (6, 7) THEN 'order_paid'
             WHEN eid % 10 = 8 THEN 'order_cancelled' WHEN eid % 10 = 9 THEN 'order_returned'
             ELSE 'order_created' END
        WHEN topic = 'ecommerce.inventory' THEN element_at(array('stock_updated_out',
             'stock_updated_in', 'low_stock_alert', 'restock_auto', 'restock_manual'),
             cast((eid div 5) % 5 as int) + 1)
        ELSE 'review_submitted' END"""),
    ("category", "element_at(array('ECONOMY', 'STANDARD', 'MEDIUM', 'LARGE', 'SMALL', 'PROMO'), cast(k % 6 as int) + 1)"),
    ("items", """IF(etype = 'order_created' AND k % 23 <> 0,
        transform(sequence(1, 1 + k % 3), j -> named_struct(
          'product_id', concat('P', cast((k + 7 * j) % 100 as string)),
          'product_name', concat('Product ', cast((k + 7 * j) % 100 as string)),
          'quantity', 1 + (k + j) % 3,
          'unit_price', base_price * j,
          'unit_cost', (base_price * j * 7) div 10)), NULL)"""),
    ("subtotal", "cast(aggregate(coalesce(items, array()), 0L, (acc, x) -> acc + x.quantity * x.unit_price) as bigint)"),
    ("discount", "CASE WHEN eid % 9 = 0 THEN NULL WHEN eid % 4 = 1 THEN (subtotal * 10) div 100 ELSE 0 END"),
    ("shipping", "IF(subtotal < 10000000, 15000, 0)"),
    ("old_q", "k % 4"),
]

_ENVELOPE = """
    'event_id', IF(reject = 0, NULL, concat('EV', cast(eid as string))),
    'event_type', CASE reject WHEN 4 THEN NULL WHEN 5 THEN 'cart_cleared' ELSE etype END,
    'timestamp', CASE reject WHEN 1 THEN NULL WHEN 2 THEN '2024-13-45 99:61:00'
                 ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END,
    'session_id', concat('S', cast(uid as string)),
    'user_id', CASE WHEN reject = 3 THEN NULL
               WHEN topic = 'ecommerce.page_view' AND uid % 29 = 0 THEN 'anonymous'
               ELSE concat('U', cast(uid as string)) END,
    'user_name', concat(' Customer ', cast(uid as string), ' '),
    'location', concat('NATION_', cast(uid % 25 as string)),
    'device_type', element_at(array('mobile', 'desktop', 'tablet'), cast(eid % 3 as int) + 1),
    'os', element_at(array('iOS', 'Android', 'Windows', 'macOS'), cast(eid % 4 as int) + 1)"""

_PAYLOAD = {
    "ecommerce.user": """
        'username', concat(' USER', cast(uid as string)),
        'gender', element_at(array('Male', 'Female', 'Other'), cast(uid % 3 as int) + 1)""",
    "ecommerce.page_view": """
        'page_name', CASE etype WHEN 'page_viewed' THEN 'home' WHEN 'product_viewed' THEN 'product_detail'
                     WHEN 'search_performed' THEN 'search' ELSE 'products' END,
        'product_id', IF(etype = 'product_viewed', concat('P', cast(k as string)), NULL),
        'product_name', IF(etype = 'product_viewed', concat('Product ', cast(k as string)), NULL),
        'category', IF(etype IN ('product_viewed', 'category_filtered'), category, NULL),
        'brand', IF(etype = 'product_viewed', concat('Brand#', cast(k % 25 + 1 as string)), NULL),
        'price', IF(etype = 'product_viewed', base_price, NULL),
        'trigger', CASE etype WHEN 'product_viewed' THEN 'click' WHEN 'search_performed' THEN 'search_box' END,
        'search_term', IF(etype = 'search_performed', concat(' item ', cast(k % 10 as string), ' '), NULL),
        'results_count', IF(etype = 'search_performed', k % 7, NULL)""",
    "ecommerce.cart": """
        'product_id', concat('P', cast(k as string)),
        'product_name', concat('Product ', cast(k as string)),
        'brand', concat('Brand#', cast(k % 25 + 1 as string)),
        'category', category,
        'unit_price', base_price,
        'quantity', CASE etype WHEN 'item_added' THEN 1 WHEN 'item_qty_updated' THEN 2 ELSE -old_q END,
        'cart_quantity_after', CASE etype WHEN 'item_added' THEN old_q + 1 WHEN 'item_qty_updated' THEN old_q + 2 ELSE 0 END,
        'old_quantity', old_q,
        'new_quantity', CASE etype WHEN 'item_added' THEN old_q + 1 WHEN 'item_qty_updated' THEN old_q + 2 ELSE 0 END""",
    "ecommerce.promo": """
        'promo_id', IF(etype = 'promo_applied', element_at(array('PROMO001', 'PROMO003', 'PROMO002'),
                    cast(k % 3 as int) + 1), NULL),
        'promo_code', CASE etype WHEN 'promo_applied' THEN element_at(array(' save10 ', 'spring10 ', ' Welcome10'),
                      cast(k % 3 as int) + 1) WHEN 'promo_removed' THEN 'SAVE10'
                      ELSE concat('bad', cast(k as string)) END,
        'discount_percent', IF(etype = 'promo_applied', cast(10.0 as float), NULL)""",
    "ecommerce.order": """
        'order_id', concat('SO', cast(eid as string)),
        'subtotal', IF(etype = 'order_created', subtotal, NULL),
        'shipping_fee', IF(etype = 'order_created', shipping, NULL),
        'discount_amount', IF(etype = 'order_created', discount, NULL),
        'total_amount', CASE etype WHEN 'order_created' THEN subtotal - coalesce(discount, 0) + shipping
                        WHEN 'order_paid' THEN base_price END,
        'payment_method', IF(etype IN ('order_created', 'order_paid'), element_at(array('COD', 'Credit Card',
                          'E-Wallet', 'Bank Transfer'), cast(eid % 4 as int) + 1), NULL),
        'promo_id', IF(etype = 'order_created' AND eid % 4 = 1, 'PROMO001', NULL),
        'promo_code', IF(etype = 'order_created' AND eid % 4 = 1, 'save10', NULL),
        'order_status', CASE etype WHEN 'order_created' THEN 'Pending' WHEN 'order_paid' THEN 'Paid'
                        WHEN 'order_cancelled' THEN 'Cancelled' ELSE 'Returned' END,
        'reason', IF(etype = 'order_cancelled', ' changed mind ', NULL),
        'items', items,
        'product_id', IF(etype = 'order_returned', concat('P', cast(k as string)), NULL),
        'quantity_returned', IF(etype = 'order_returned', 1 + k % 2, NULL)""",
    "ecommerce.inventory": """
        'product_id', concat('P', cast(k as string)),
        'product_name', concat('Product ', cast(k as string)),
        'order_id', IF(etype IN ('stock_updated_out', 'stock_updated_in'), concat('SO', cast(eid as string)), NULL),
        'quantity_sold', IF(etype = 'stock_updated_out', 1 + k % 3, NULL),
        'quantity_returned', IF(etype = 'stock_updated_in', 1 + k % 2, NULL),
        'quantity_added', IF(etype IN ('restock_auto', 'restock_manual'), 50, NULL),
        'stock_remaining', CASE WHEN etype = 'low_stock_alert' THEN k % 10
                           WHEN etype IN ('restock_auto', 'restock_manual') THEN k % 30 + 50 ELSE k % 30 END""",
    "ecommerce.review": """
        'product_id', concat('P', cast(k as string)),
        'rating', cast(eid % 7 as int),
        'comment_length', (k % 4) * 10""",
}


def topic_route(topic: str) -> str:
    """SQL predicate on an events row: does it go to ``topic``?"""
    i = ALL_TOPICS.index(topic)
    normal = {
        "ecommerce.user": "event_type = 'signup'",
        "ecommerce.page_view": "event_type = 'view' AND event_id % 5 <> 0",
        "ecommerce.review": "event_type = 'view' AND event_id % 5 = 0",
        "ecommerce.cart": "event_type = 'click' AND event_id % 5 <> 0",
        "ecommerce.promo": "event_type = 'click' AND event_id % 5 = 0",
        "ecommerce.order": "event_type = 'purchase' AND event_id % 5 <> 0",
        "ecommerce.inventory": "event_type = 'purchase' AND event_id % 5 = 0",
    }[topic]
    return f"(({normal}) OR (event_type = 'error' AND event_id % 7 = {i}))"


def topic_log(events: DataFrame, topic: str) -> DataFrame:
    """The messages of one topic: (topic, partition, offset, kafka_timestamp, json_str)."""
    df = (events.select("event_id", "ts", "user_id", "event_type", "value", "props")
                .filter(F.expr(topic_route(topic))))
    for name, expr in _STEPS:
        if name == "topic":
            expr = f"'{topic}'"
        df = df.withColumn(name, F.expr(expr))
    msg = f"to_json(named_struct({_ENVELOPE}, {_PAYLOAD[topic]}))"
    df = df.withColumn("json_str", F.expr(
        f"IF(reject = 6, concat('{{\"event_id\": \"EV', cast(eid as string), '\", broken'), {msg})"))
    df = df.withColumn("copy", F.explode(F.expr("sequence(0, IF(eid % 50 = 0, 1, 0))")))
    return df.select(
        F.lit(topic).alias("topic"),
        F.expr("cast(eid % 3 as int)").alias("partition"),
        F.expr("eid * 2 + copy").alias("offset"),
        F.col("ts").cast("timestamp").alias("kafka_timestamp"),
        "json_str",
    )


def raw_event_log(events: DataFrame) -> DataFrame:
    """All topics: a union of per-topic logs. A filter on ``topic`` prunes
    the other branches at plan time, so one topic's job builds one topic."""
    out = None
    for t in ALL_TOPICS:
        part = topic_log(events, t)
        out = part if out is None else out.unionByName(part)
    return out
