"""Sources, sinks, Bronze and the stream stages as registered round trips
(SURVEY §2.1, §2.2, §2.6, §2.7 Silver tables).

Sinks are checked write-then-read: the operator writes under the shared
checkpoint folder and the query returns what was read back. Clock columns
(``quarantined_at``) are dropped before comparison.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lake import EVENTS_AS_OF, ORDERS_AS_OF
from ..operators import bronze as B
from ..operators import silver as S
from ..operators import stream_topics as ST
from ..oracle.sql import AS_OF, BATCH_ID, EV_AS_OF, with_ctes
from ..registry import ORACLES, QUERIES, lake, register
from ..schemas import ALL_TOPICS, ENVELOPE_FIELDS, TOPIC_CART, TOPIC_ORDER, TOPIC_SCHEMAS
from ..session import scratch_path
from ..sources import io
from ..streaming import carts, runner
from . import commerce_ops, sales  # noqa: F401 - their oracles are used here
from .catalog import SharedQueryCache

c = F.col


def _fresh(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:8]}")


def date_spine(orders: DataFrame, col: str = "o_orderdate") -> DataFrame:
    """One row per day between the first and last value of ``col``."""
    b = orders.agg(F.min(F.to_date(col)).alias("d0"), F.max(F.to_date(col)).alias("d1"))
    return b.select(F.explode(F.sequence("d0", "d1", F.expr("INTERVAL 1 DAY"))).alias("date_key"))


_RAW_DIRS: dict[tuple, str] = {}


#: rows of a file of the raw event log (a task sorts a file's rows by topic),
#: and files of a micro-batch of its readers at most
RAW_FILE_ROWS, BATCH_FILES = 250_000, 8


def raw_files(spark: SparkSession, sf_dir: str, n_files: int | None = None) -> str:
    """The raw event log written as parquet files (the Kafka source's file
    twin), split by offset so files are successive batches. Their number
    follows the number of events, four at least."""
    key = (id(spark), sf_dir)
    if key not in _RAW_DIRS:
        path = _fresh(spark, "raw-events")
        raw = lake(spark, sf_dir).raw_events()
        n_files = n_files or max(4, -(-lake(spark, sf_dir).raw("events").count() // RAW_FILE_ROWS))
        io.write_raw_files(raw, path, n_files)
        _RAW_DIRS[key] = path
    return _RAW_DIRS[key]


def batch_files(spark: SparkSession, sf_dir: str) -> int:
    """Files that a micro-batch of one topic takes: the log is four batches, or
    as many of ``BATCH_FILES`` files as it needs."""
    files = -(-lake(spark, sf_dir).raw("events").count() // RAW_FILE_ROWS)
    return max(1, min(BATCH_FILES, files // 4))


# ------------------------------------------------------------ sources
def _jdbc(spark, d):
    url = f"jdbc:derby:memory:tidemart_{uuid.uuid4().hex[:8]};create=true"
    props = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    inv = lake(spark, d).src.entity("inventory")
    io.write_jdbc(inv, url, "INVENTORY", mode="overwrite", properties=props)
    return io.read_jdbc(spark, url, "INVENTORY", partition_column="stock_quantity", lower=-2, upper=58,
                        num_partitions=4, properties=props).select(
        c("PRODUCT_ID").alias("product_id"), c("IMPORT_PRICE").alias("import_price"),
        c("STOCK_QUANTITY").alias("stock_quantity"), c("LAST_RESTOCK_DATE").alias("last_restock_date"))


register("source_jdbc", with_ctes("SELECT * FROM a_inventory"))(_jdbc)


def _jdbc_incremental(spark, d):
    """Orders arrive in two halves by key; each run reads what is new. Keys
    are squared, so even ranges of them would be uneven parts."""
    url = f"jdbc:derby:memory:tidemart_{uuid.uuid4().hex[:8]};create=true"
    props = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = lake(spark, d).raw("orders").select((c("o_orderkey") * c("o_orderkey")).alias("order_no"), c("o_orderkey").alias("order_key"), c("o_custkey").alias("customer_key"))
    half = rows.agg(F.max("order_key")).first()[0] // 2
    mark, out = io.HighWaterMark(spark, _fresh(spark, "jdbc-mark")), _fresh(spark, "jdbc-new")
    for run, part in enumerate((c("order_key") <= half, c("order_key") > half, F.lit(False))):
        io.write_jdbc(rows.filter(part), url, "ORDERS", properties=props)
        new, upto = io.read_jdbc_new(spark, url, "ORDERS", '"order_no"', mark, 8, props)
        new.toDF("order_no", "order_key", "customer_key").withColumn("run", F.lit(run)).write.mode("append").parquet(out)
        if upto is not None:
            mark.advance(upto)
    return spark.read.parquet(out)


register("source_jdbc_incremental", """
SELECT o_orderkey * o_orderkey AS order_no, o_orderkey AS order_key, o_custkey AS customer_key,
       CAST(CASE WHEN o_orderkey <= (SELECT max(o_orderkey) // 2 FROM orders) THEN 0 ELSE 1 END AS INTEGER) AS run FROM orders""")(_jdbc_incremental)


def _kafka_twin(spark, d):
    src = raw_files(spark, d)
    out, ck = _fresh(spark, "kafka-twin-out"), _fresh(spark, "kafka-twin-ck")
    q = (io.read_raw_files_stream(spark, src, max_files_per_trigger=len(ALL_TOPICS) * batch_files(spark, d)).writeStream.format("parquet")
         .option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


register("source_kafka", with_ctes("SELECT topic, partition, \"offset\", kafka_timestamp, json_str FROM ev_raw"))(_kafka_twin)

register("source_static_rows", with_ctes("SELECT * FROM a_promotions"))(
    lambda spark, d: lake(spark, d).src.entity("promotions"))

register("source_date_spine", with_ctes("""
SELECT CAST(d AS DATE) AS date_key FROM (
  SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d
  FROM (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders))"""))(
    lambda spark, d: date_spine(lake(spark, d).raw("orders")))


# -------------------------------------------------------------- sinks
def _sink_table(spark, d):
    path = _fresh(spark, "fact_sales")
    io.write_table(lake(spark, d).table("fact_sales"), path)
    return spark.read.parquet(path)


register("sink_table", with_ctes("SELECT * FROM fact_sales"))(_sink_table)


def _sink_quarantine(entity):
    def run(spark, d):
        path = _fresh(spark, f"quarantine_{entity}")
        io.write_quarantine(lake(spark, d).quarantine(entity), path)
        return spark.read.parquet(path).drop("quarantined_at")
    return run


for _e in ["users", "products", "promotions", "orders", "order_items", "inventory_logs", "reviews"]:
    register("sink_quarantine" if _e == "orders" else f"sink_quarantine_{_e}", with_ctes(f"SELECT * FROM q_{_e}"))(_sink_quarantine(_e))


def _stream_append(topic, table):
    def run(spark, d):
        root, ck = _fresh(spark, "stream-out"), _fresh(spark, "stream-ck")
        runner.run_files_available_now(spark, raw_files(spark, d), root, ck, topics=[topic], max_files_per_trigger=batch_files(spark, d), steps=("facts",))
        return runner.read_layer(spark, root, "gold", table).drop("batch_id", "run_id")
    return run


for _topic, _table in [(t, n) for t, spec in ST.TOPICS.items() for n in spec.gold_tables]:
    register("sink_stream_append" if _table == "fact_orders_stream" else f"sink_stream_append_{_table}",
             with_ctes(f"SELECT * FROM {_table}"))(_stream_append(_topic, _table))


def _stream_quarantine_sink(spark, d):
    """The rejects of every topic as the job stores them."""
    root, ck = _fresh(spark, "stream-out"), _fresh(spark, "stream-ck")
    runner.run_files_available_now(spark, raw_files(spark, d), root, ck, max_files_per_trigger=batch_files(spark, d), steps=("raw",))
    out = None
    for t in ALL_TOPICS:
        q = runner.read_layer(spark, root, "quarantine", "events", io.topic_dir(t)).drop("batch_id", "run_id", "ingested_at")
        out = q if out is None else out.unionByName(q)
    return out


register("sink_quarantine_events", with_ctes("""
SELECT q.event_id, q.event_type, q.timestamp, q.user_id, q.source_topic, q.quarantine_reason, q.topic, q.partition, q."offset", q.kafka_timestamp, r.json_str
FROM quarantine_events q JOIN ev_raw r ON r.topic = q.topic AND r."offset" = q."offset\""""))(_stream_quarantine_sink)


def _cart_stream(spark, d):
    """The cart table that the stream keeps, after the whole log."""
    root = _fresh(spark, "carts")
    src = io.read_raw_files_stream(spark, raw_files(spark, d), batch_files(spark, d), TOPIC_CART)
    q = carts.start_carts(src, root, _fresh(spark, "carts-ck"), {"availableNow": True}, buckets=8)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return carts.read_carts(spark, root)


register("cart_state_stream", ORACLES["cart_state"])(_cart_stream)


def _cached(spark, d):
    """A stored result, found again by its plan and the files it reads."""
    cache = SharedQueryCache(spark, _fresh(spark, "query-cache"))
    query = QUERIES["category_revenue"](spark, d)
    cache.fetch(query)
    found, hit = cache.fetch(QUERIES["category_revenue"](spark, d))
    if not hit:
        raise RuntimeError("the stored result was not found")
    return found


register("query_cached", ORACLES["category_revenue"])(_cached)


def _event_json_round_trip(spark, d):
    """Serialise the order facts to one JSON value per row, write the values,
    read them back and parse them with the fact's own schema: the round trip
    must give the facts back (JSON number text differs between engines, so
    the check is on the parsed values)."""
    facts = lake(spark, d).table("fact_orders_stream")
    path = _fresh(spark, "event-json")
    io.write_table(io.to_event_json(facts), path)
    back = spark.read.parquet(path)
    return back.select(F.from_json("value", facts.schema).alias("r")).select("r.*")


register("sink_event_json", with_ctes("SELECT * FROM fact_orders_stream"))(_event_json_round_trip)


# ------------------------------------------------------------- bronze
_AUDIT = f"{AS_OF} AS ingested_at, {BATCH_ID} AS batch_id"
register("bronze_snapshot", with_ctes(f"SELECT *, {_AUDIT}, 'postgresql.orders' AS source FROM a_orders"))(
    lambda spark, d: lake(spark, d).bronze("orders"))
register("bronze_users", with_ctes(f"""
SELECT user_id, username, full_name, email, phone, gender, location, created_at, is_active, {_AUDIT},
       'postgresql.users' AS source FROM a_users"""))(lambda spark, d: lake(spark, d).bronze("users"))
for _e in ["products", "inventory", "promotions", "order_items", "inventory_logs", "reviews"]:
    register(f"bronze_{_e}", with_ctes(f"SELECT *, {_AUDIT}, 'postgresql.{_e}' AS source FROM a_{_e}"))(
        (lambda e: lambda spark, d: lake(spark, d).bronze(e))(_e))
register("bronze_raw_events", with_ctes(f"""
SELECT topic, partition, "offset", kafka_timestamp, json_str, {EV_AS_OF} AS ingested_at FROM ev_raw"""))(
    lambda spark, d: B.bronze_raw_events(lake(spark, d).raw_events(), EVENTS_AS_OF))


def dedup_two_runs(lk) -> DataFrame:
    """Two Bronze runs of orders; the second is newer and moved updated_at
    forward. Silver dedup must keep exactly the second run's rows."""
    later = ORDERS_AS_OF + dt.timedelta(days=1)
    b1 = lk.bronze("orders")
    b2 = B.bronze_snapshot(lk.src.entity("orders").withColumn("updated_at", c("updated_at") + F.expr("INTERVAL 1 DAY")),
                           "orders", later.strftime("%Y%m%d_%H%M%S"), later)
    good, _ = S.split_valid(b1.unionByName(b2), S.rules("orders"))
    return S.dedup("orders", S.project("orders", good))


register("dedup_latest", with_ctes("""
SELECT * REPLACE (updated_at + INTERVAL 1 DAY AS updated_at, TIMESTAMP '2001-08-03 00:00:00' AS ingested_at,
                  '20010803_000000' AS batch_id) FROM s_orders"""))(lambda spark, d: dedup_two_runs(lake(spark, d)))


# ------------------------------------------------------- stream stages
def _parsed(spark, d, topic):
    raw = lake(spark, d).raw_events().filter(c("topic") == topic)
    return ST.parse(raw, topic, EVENTS_AS_OF)


# What a message of any topic has, after the parse: the envelope as text, the
# record's coordinates and its text. Null where the record couldn't be parsed.
_WHOLE = "reject <> 6"
_ENVELOPE_SQL = f"""
SELECT CASE WHEN reject NOT IN (0, 6) THEN event_id END AS event_id,
       CASE WHEN reject = 5 THEN 'cart_cleared' WHEN reject NOT IN (4, 6) THEN etype END AS event_type,
       CASE WHEN reject = 2 THEN '2024-13-45 99:61:00' WHEN reject NOT IN (1, 6) THEN strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') END AS timestamp,
       CASE WHEN {_WHOLE} THEN session_id END AS session_id, CASE WHEN reject NOT IN (3, 6) THEN user_id END AS user_id,
       CASE WHEN {_WHOLE} THEN ' ' || user_name || ' ' END AS user_name, CASE WHEN {_WHOLE} THEN location END AS location,
       CASE WHEN {_WHOLE} THEN device_type END AS device_type, CASE WHEN {_WHOLE} THEN os END AS os,
       CASE WHEN {_WHOLE} THEN json_str END AS payload, topic, partition, "offset", kafka_timestamp, json_str, {EV_AS_OF} AS ingested_at"""


def _with_payload(parsed: DataFrame, topic: str) -> DataFrame:
    """A parsed topic with all its parsed fields as one JSON text, which holds
    the record's own text again if no field was lost or changed."""
    fields = [f.name for f in TOPIC_SCHEMAS[topic].fields]
    whole = F.to_json(F.struct(*[c(f) for f in fields]))
    return parsed.select(*ENVELOPE_FIELDS, F.when(c(ST.CORRUPT).isNull(), whole).alias("payload"), *ST.COORDS, "json_str", "ingested_at")


def _all_topics(one) -> DataFrame:
    out = None
    for t in ALL_TOPICS:
        out = one(t) if out is None else out.unionByName(one(t))
    return out


register("stream_parse", with_ctes(f"{_ENVELOPE_SQL} FROM ev_raw"))(
    lambda spark, d: _all_topics(lambda t: _with_payload(_parsed(spark, d, t), t)))

_GOOD = "reject = -1 AND NOT (topic = 'ecommerce.review' AND eid % 7 IN (0, 6))"
register("stream_dedup", with_ctes(f"{_ENVELOPE_SQL} FROM ev_raw WHERE {_GOOD} AND \"offset\" % 2 = 0"))(
    lambda spark, d: _all_topics(lambda t: _with_payload(ST.split_topic(_parsed(spark, d, t), t)[0], t)))


def _stream_dedup_state(spark, d):
    """What the facts queries accept of the log, with the ids in the engine's
    state: every valid event once, whichever delivery of it came through."""
    runner.use_state_store(spark)
    queries = []
    for t in ALL_TOPICS:
        out = _fresh(spark, f"dedup-{io.topic_dir(t)}")
        events = runner.fresh_events(ST.parse(io.read_raw_files_stream(spark, raw_files(spark, d), batch_files(spark, d), t), t), t)
        q = (events.select("topic", "event_id", "event_type", "timestamp", "user_id", "json_str").writeStream.format("parquet")
             .option("path", out).option("checkpointLocation", _fresh(spark, "dedup-ck")).trigger(availableNow=True).start())
        queries.append((q, out))
    for q, _ in queries:
        q.awaitTermination()
    return spark.read.parquet(*[out for _, out in queries])


register("stream_dedup_state", with_ctes(f"""
SELECT topic, event_id, etype AS event_type, strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS timestamp, user_id, json_str
FROM ev_raw WHERE {_GOOD} AND \"offset\" % 2 = 0"""))(_stream_dedup_state)


def _validate_counts(spark, d):
    out = None
    for t in ALL_TOPICS:
        p = _parsed(spark, d, t)
        r = p.select(c("topic"), ST.quality_reason(t).alias("quarantine_reason"))
        out = r if out is None else out.unionByName(r)
    return out.groupBy("topic", "quarantine_reason").agg(F.count("*").alias("n"))


register("stream_validate", with_ctes("""
SELECT topic, CASE reject WHEN 6 THEN 'unparsable json' WHEN 0 THEN 'null event_id' WHEN 1 THEN 'null timestamp'
            WHEN 2 THEN 'bad timestamp' WHEN 3 THEN 'null user_id' WHEN 4 THEN 'null event_type'
            WHEN 5 THEN 'unknown event_type'
            ELSE CASE WHEN topic = 'ecommerce.review' AND eid % 7 IN (0, 6) THEN 'null or out-of-range rating (1–5)'
                 END END AS quarantine_reason, CAST(sum(copies) AS BIGINT) AS n
FROM ev GROUP BY 1, 2"""))(_validate_counts)

register("order_items_explode", with_ctes("""
SELECT event_id, 'SO' || CAST(eid AS VARCHAR) AS order_id, i_product_id AS product_id, i_product_name AS product_name,
       i_quantity AS quantity, i_unit_price AS unit_price, i_unit_cost AS unit_cost FROM ord_items"""))(
    lambda spark, d: lake(spark, d).topic(TOPIC_ORDER).exploded.select(
        "event_id", "order_id", c("i_product_id").alias("product_id"), c("i_product_name").alias("product_name"),
        c("i_quantity").alias("quantity"), c("i_unit_price").alias("unit_price"), c("i_unit_cost").alias("unit_cost")))


# Silver event tables: trimmed and typed topic fields + coordinates.
_TAIL = f'topic, "partition", "offset", kafka_timestamp, {EV_AS_OF} AS ingested_at'
_SILVER_EVENTS = {
    "silver_user_events": ("ecommerce.user", f"""
SELECT event_id, etype AS event_type, event_ts, session_id, user_id, user_name, 'user' || CAST(uid AS VARCHAR) AS username,
       ['Male', 'Female', 'Other'][CAST(uid % 3 AS INTEGER) + 1] AS gender, location, device_type, os, {_TAIL}
FROM evg WHERE topic = 'ecommerce.user'"""),
    "silver_page_view_events": ("ecommerce.page_view", f"""
SELECT v.event_id, v.event_type, v.event_ts, v.session_id, v.user_id, v.device_type, v.os, v.location, v.page_name,
       v.product_id, v.product_name, v.category, v.brand, v.price, v.search_item AS search_term,
       v.result_count AS results_count, v.trigger, e.{_TAIL.replace(', ', ', e.', 3)}
FROM fact_page_views v JOIN evg e USING (event_id)"""),
    "silver_cart_events": ("ecommerce.cart", f"""
SELECT v.event_id, v.event_type, v.event_ts, v.session_id, v.user_id, v.device_type, v.os, v.product_id,
       v.product_name, v.brand, v.category, v.unit_price,
       CAST(CASE v.event_type WHEN 'item_added' THEN 1 WHEN 'item_qty_updated' THEN 2 ELSE -(e.k % 4) END AS BIGINT)
         AS quantity, v.cart_quantity_after, v.old_quantity, v.new_quantity, e.{_TAIL.replace(', ', ', e.', 3)}
FROM fact_cart_events v JOIN evg e USING (event_id)"""),
    "silver_promo_events": ("ecommerce.promo", f"""
SELECT v.event_id, v.event_type, v.event_ts, v.session_id, v.user_id, v.promo_id, v.promo_code, v.discount_percent,
       e.{_TAIL.replace(', ', ', e.', 3)}
FROM fact_promo_events v JOIN evg e USING (event_id)"""),
    "silver_inventory_events": ("ecommerce.inventory", f"""
SELECT v.event_id, v.event_type, v.event_ts, e.user_id, v.product_id, v.product_name, v.order_id,
       CAST(CASE WHEN v.event_type = 'stock_updated_out' THEN 1 + e.k % 3 END AS BIGINT) AS quantity_sold,
       CAST(CASE WHEN v.event_type = 'stock_updated_in' THEN 1 + e.k % 2 END AS BIGINT) AS quantity_returned,
       CAST(CASE WHEN v.event_type IN ('restock_auto', 'restock_manual') THEN 50 END AS BIGINT) AS quantity_added,
       v.stock_remaining, e.{_TAIL.replace(', ', ', e.', 3)}
FROM fact_inventory_events v JOIN evg e USING (event_id)"""),
    "silver_review_events": ("ecommerce.review", f"""
SELECT v.event_id, v.event_type, v.event_ts, v.user_id, v.product_id, v.rating, v.comment_length,
       e.{_TAIL.replace(', ', ', e.', 3)}
FROM fact_review_events v JOIN evg e USING (event_id)"""),
    "silver_order_events": ("ecommerce.order", f"""
SELECT v.event_id, v.event_type, v.event_ts, v.session_id, v.user_id, v.device_type, v.os, v.location, v.order_id,
       v.subtotal, v.shipping_fee, v.discount_amount, v.total_amount, v.payment_method, v.promo_id, v.promo_code,
       v.order_status, v.reason, i.items, e.{_TAIL.replace(', ', ', e.', 3)}
FROM fact_orders_stream v JOIN evg e USING (event_id) LEFT JOIN (
  SELECT event_id, string_agg(concat_ws(':', i_product_id, i_product_name, i_quantity, i_unit_price, i_unit_cost), '|' ORDER BY j) AS items
  FROM ord_items GROUP BY ALL) i USING (event_id)"""),
}

def _flat_items(silver: DataFrame) -> DataFrame:
    """Item arrays as one text, field by field, which both engines print alike."""
    if "items" not in silver.columns:
        return silver
    fields = ("product_id", "product_name", "quantity", "unit_price", "unit_cost")
    return silver.withColumn("items", F.array_join(F.transform("items", lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), "|"))


for _name, (_topic, _sql) in _SILVER_EVENTS.items():
    register(_name, with_ctes(_sql))(
        (lambda t: lambda spark, d: _flat_items(lake(spark, d).topic(t).silver))(_topic))
