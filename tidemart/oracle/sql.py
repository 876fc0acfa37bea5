"""DuckDB twins of every layer, used as the independent oracle.

Each layer is a CTE written directly in DuckDB SQL from the rules in the
docstrings of ``tidemart.sources`` and ``tidemart.operators``; a query's
oracle is ``WITH <all CTEs> <final SELECT>``. The stream layers are
computed straight from ``events`` (no JSON round trip), which checks the
Spark side's serialise -> parse -> validate path end to end.

DuckDB vs Spark traps handled here: dayofweek is 0-based; ``//`` is
integral division; ``round`` on doubles is done through DECIMAL where the
Spark side rounds HALF_UP; integer sums are cast back to BIGINT.
"""

from __future__ import annotations

from ..schemas import ALL_TOPICS, VALID_EVENT_TYPES

AS_OF = "TIMESTAMP '2001-08-02 00:00:00'"
EV_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
BATCH_ID = "'20010802_000000'"
AUDIT = f"{AS_OF} AS ingested_at, {BATCH_ID} AS batch_id"


def _vs(x):
    return f"CAST({x} AS VARCHAR)"


def pct_sql(num: str, den: str) -> str:
    """round(num / den * 100, 2) HALF_UP in integers, as DOUBLE; null at 0."""
    return (f"(CASE WHEN ({den}) <> 0 THEN sign({num}) * sign({den}) * "
            f"((abs({num}) * 20000 + abs({den})) // (abs({den}) * 2)) END) / CAST(100 AS DOUBLE)")


def avg_pct_sql(x: str) -> str:
    return f"(sum(CAST(round({x} * 100) AS BIGINT)) / count({x})) / CAST(100 AS DOUBLE)"


_topic_case = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(ALL_TOPICS))
_first_type = " ".join(f"WHEN '{t}' THEN '{VALID_EVENT_TYPES[t][0]}'" for t in ALL_TOPICS)

CTES: list[tuple[str, str]] = []


def cte(name, sql):
    CTES.append((name, sql))


# --------------------------------------------------------------- entities
cte("a_users", f"""
SELECT 'U' || {_vs('c.c_custkey')} AS user_id,
       CASE WHEN c.c_custkey % 97 <> 0 THEN ' ' || upper(c.c_name) END AS username,
       c.c_name AS full_name, ' ' || c.c_name || '@Shop.Test' AS email,
       '09' || lpad({_vs('c.c_custkey')}, 8, '0') AS phone,
       CASE c.c_custkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'Other' END AS gender,
       n.n_name AS location,
       CAST(DATE '1994-01-01' + CAST(c.c_custkey % 300 AS INTEGER) AS TIMESTAMP) AS created_at,
       c.c_custkey % 10 <> 0 AS is_active
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")

cte("a_products", f"""
SELECT 'P' || {_vs('p_partkey')} AS product_id, p_name AS product_name, p_brand AS brand,
       p_type AS category,
       CASE WHEN p_partkey % 89 = 0 THEN 0 WHEN p_partkey % 89 = 1 THEN NULL
            ELSE CAST(round(p_retailprice * 100) AS BIGINT) * (p_partkey % 300 + 1) END AS price,
       'img/P' || {_vs('p_partkey')} || '.png' AS image_url,
       TIMESTAMP '2023-01-01 00:00:00' AS created_at, p_partkey % 17 <> 0 AS is_active
FROM part""")

cte("a_inventory", f"""
SELECT 'P' || {_vs('p_partkey')} AS product_id,
       (CAST(round(p_retailprice * 100) AS BIGINT) * (p_partkey % 300 + 1) * 7) // 10 AS import_price,
       p_partkey % 60 - 2 AS stock_quantity,
       CAST(DATE '2001-01-01' + CAST(p_partkey % 200 AS INTEGER) AS TIMESTAMP) AS last_restock_date
FROM part WHERE p_partkey % 83 <> 0""")

cte("a_promotions", """
SELECT * FROM (VALUES
  ('PROMO001', 'SAVE10', CAST(10.00 AS DECIMAL(5,2)), TIMESTAMP '1995-01-01 00:00:00', TIMESTAMP '1999-12-31 23:59:59', TRUE),
  ('PROMO002', ' welcome10 ', CAST(10.00 AS DECIMAL(5,2)), TIMESTAMP '1997-01-01 00:00:00', TIMESTAMP '2001-12-31 23:59:59', TRUE),
  ('PROMO003', 'SPRING10', CAST(10.00 AS DECIMAL(5,2)), TIMESTAMP '1996-01-01 00:00:00', CAST(NULL AS TIMESTAMP), TRUE)
) AS t(promo_id, promo_code, discount_percent, start_date, end_date, is_active)
UNION ALL
SELECT 'PV' || CAST(c_custkey AS VARCHAR),
       CASE WHEN c_custkey % 200 <> 0 THEN ' vip' || CAST(c_custkey AS VARCHAR) || ' ' END,
       CAST(c_custkey % 11 + 5 AS DECIMAL(5,2)),
       CAST(DATE '2000-01-01' + CAST(c_custkey % 365 AS INTEGER) AS TIMESTAMP),
       CASE WHEN c_custkey % 4 <> 0 THEN CAST(DATE '2000-01-01' + CAST(c_custkey % 365 AS INTEGER) AS TIMESTAMP)
            + INTERVAL 180 DAY END,
       c_custkey % 3 <> 0
FROM customer WHERE c_custkey % 25 = 0""")

cte("a_lines", """
SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
         l_shipdate) AS item_id,
       l_orderkey, l_partkey, l_returnflag, CAST(l_shipdate AS TIMESTAMP) AS l_shipdate,
       CASE WHEN l_orderkey % 101 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS quantity,
       CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT) AS unit_price
FROM lineitem""")

cte("a_order_items", f"""
SELECT item_id, 'ORD_' || {_vs('l_orderkey')} AS order_id, 'P' || {_vs('l_partkey')} AS product_id,
       quantity, unit_price, (unit_price * 7) // 10 AS unit_cost, quantity * unit_price AS item_total
FROM a_lines""")

cte("a_orders", f"""
SELECT 'ORD_' || {_vs('o.o_orderkey')} AS order_id,
       CASE WHEN o.o_orderkey % 103 <> 0 THEN 'U' || {_vs('o.o_custkey')} END AS user_id,
       CASE WHEN o.o_orderkey % 10 < 3 THEN 'PROMO00' || {_vs('o.o_orderkey % 10 + 1')} END AS promo_id,
       sub AS subtotal,
       CAST(CASE WHEN sub < 10000000 THEN 15000 ELSE 0 END AS BIGINT) AS shipping_fee,
       disc AS discount_amount,
       CASE WHEN o.o_orderkey % 107 = 0 THEN 0
            ELSE sub - coalesce(disc, 0) + CASE WHEN sub < 10000000 THEN 15000 ELSE 0 END END AS total_amount,
       CASE o.o_orderkey % 4 WHEN 0 THEN 'COD' WHEN 1 THEN 'Credit Card' WHEN 2 THEN 'E-Wallet'
            ELSE 'Bank Transfer' END AS payment_method,
       CASE o.o_orderstatus WHEN 'F' THEN 'Delivered'
            WHEN 'O' THEN CASE o.o_orderkey % 3 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Processing' ELSE 'Shipped' END
            ELSE CASE o.o_orderkey % 2 WHEN 0 THEN 'Cancelled' ELSE 'Returned' END END AS order_status,
       CAST(o.o_orderdate AS TIMESTAMP) AS order_date,
       CAST(o.o_orderdate AS TIMESTAMP) + INTERVAL 2 DAY AS updated_at
FROM (SELECT o.*, coalesce(s.sub, 0) AS sub,
             CASE WHEN o.o_orderkey % 53 = 0 THEN NULL
                  WHEN o.o_orderkey % 10 < 3 THEN (coalesce(s.sub, 0) * 10) // 100 ELSE 0 END AS disc
      FROM orders o LEFT JOIN (SELECT l_orderkey, CAST(sum(quantity * unit_price) AS BIGINT) AS sub
                               FROM a_lines GROUP BY l_orderkey) s ON s.l_orderkey = o.o_orderkey) o""")

cte("a_inventory_logs", f"""
SELECT item_id * 3 AS log_id, 'P' || {_vs('l_partkey')} AS product_id, 'ORD_' || {_vs('l_orderkey')} AS order_id,
       CASE WHEN l_orderkey % 211 <> 0 THEN ' out' END AS transaction_type, quantity AS quantity_changed,
       'checkout' AS note, l_shipdate AS created_at FROM a_lines
UNION ALL
SELECT item_id * 3 + 1, 'P' || {_vs('l_partkey')}, 'ORD_' || {_vs('l_orderkey')}, 'Return ', quantity, 'return',
       l_shipdate + INTERVAL 10 DAY FROM a_lines WHERE l_returnflag = 'R'
UNION ALL
SELECT p_partkey * 3 + 2, 'P' || {_vs('p_partkey')}, CAST(NULL AS VARCHAR), 'IN', 50, 'restock',
       TIMESTAMP '1995-01-01 00:00:00' FROM part""")

cte("a_reviews", f"""
SELECT event_id AS review_id, 'P' || {_vs("CAST(json_extract_string(props, '$.k') AS INTEGER)")} AS product_id,
       'U' || {_vs('user_id')} AS user_id, CAST(event_id % 7 AS INTEGER) AS rating,
       CASE event_id % 3 WHEN 1 THEN '   '
            WHEN 2 THEN ' nice product ' || {_vs("CAST(json_extract_string(props, '$.k') AS INTEGER)")} END AS comment,
       CAST(ts AS TIMESTAMP) AS review_date
FROM events WHERE event_type = 'view'""")

# ----------------------------------------------------------------- silver
cte("s_users", f"""
SELECT trim(user_id) AS user_id, lower(trim(username)) AS username, trim(full_name) AS full_name,
       lower(trim(email)) AS email, trim(phone) AS phone, trim(gender) AS gender, trim(location) AS location,
       created_at, is_active, {AUDIT}
FROM a_users WHERE user_id IS NOT NULL AND username IS NOT NULL""")

cte("s_products", f"""
SELECT trim(product_id) AS product_id, trim(product_name) AS product_name, trim(brand) AS brand,
       trim(category) AS category, price, image_url, created_at, is_active, {AUDIT}
FROM a_products WHERE product_id IS NOT NULL AND price > 0""")

cte("s_inventory", f"""
SELECT trim(product_id) AS product_id, import_price, greatest(stock_quantity, 0) AS stock_quantity,
       last_restock_date, {AUDIT}
FROM a_inventory WHERE product_id IS NOT NULL""")

cte("s_promotions", f"""
SELECT trim(promo_id) AS promo_id, upper(trim(promo_code)) AS promo_code, discount_percent,
       start_date, end_date, is_active, {AUDIT}
FROM a_promotions WHERE promo_id IS NOT NULL AND promo_code IS NOT NULL""")

cte("s_orders", f"""
SELECT trim(order_id) AS order_id, trim(user_id) AS user_id, trim(promo_id) AS promo_id, subtotal,
       shipping_fee, coalesce(discount_amount, 0) AS discount_amount, total_amount,
       trim(payment_method) AS payment_method, trim(order_status) AS order_status, order_date, updated_at, {AUDIT}
FROM a_orders WHERE order_id IS NOT NULL AND user_id IS NOT NULL AND total_amount > 0""")

cte("s_order_items", f"""
SELECT item_id, trim(order_id) AS order_id, trim(product_id) AS product_id, quantity, unit_price,
       unit_cost, item_total, {AUDIT}
FROM a_order_items WHERE order_id IS NOT NULL AND product_id IS NOT NULL AND quantity > 0 AND unit_price > 0""")

cte("s_inventory_logs", f"""
SELECT log_id, trim(product_id) AS product_id, trim(order_id) AS order_id,
       upper(trim(transaction_type)) AS transaction_type, quantity_changed, note, created_at, {AUDIT}
FROM a_inventory_logs WHERE product_id IS NOT NULL AND transaction_type IS NOT NULL""")

cte("s_reviews", f"""
SELECT review_id, trim(product_id) AS product_id, trim(user_id) AS user_id, rating, trim(comment) AS comment,
       review_date, {AUDIT}
FROM a_reviews WHERE product_id IS NOT NULL AND user_id IS NOT NULL AND rating BETWEEN 1 AND 5""")

# ------------------------------------------------------------- quarantine
_BRONZE = f"{AS_OF} AS ingested_at, {BATCH_ID} AS batch_id"
cte("q_users", f"""
SELECT user_id, username, full_name, email, phone, gender, location, created_at, is_active, {_BRONZE},
       'postgresql.users' AS source, 'null user_id or username' AS quarantine_reason
FROM a_users WHERE user_id IS NULL OR username IS NULL""")
cte("q_products", f"""
SELECT *, {_BRONZE}, 'postgresql.products' AS source, 'null product_id or invalid price' AS quarantine_reason
FROM a_products WHERE product_id IS NULL OR price IS NULL OR price <= 0""")
cte("q_promotions", f"""
SELECT *, {_BRONZE}, 'postgresql.promotions' AS source, 'null promo_id or promo_code' AS quarantine_reason
FROM a_promotions WHERE promo_id IS NULL OR promo_code IS NULL""")
cte("q_orders", f"""
SELECT *, {_BRONZE}, 'postgresql.orders' AS source,
       'null order_id/user_id or non-positive total' AS quarantine_reason
FROM a_orders WHERE order_id IS NULL OR user_id IS NULL OR total_amount IS NULL OR total_amount <= 0""")
cte("q_order_items", f"""
SELECT *, {_BRONZE}, 'postgresql.order_items' AS source, 'null FK or invalid qty/price' AS quarantine_reason
FROM a_order_items WHERE order_id IS NULL OR product_id IS NULL OR coalesce(quantity <= 0, TRUE)
   OR coalesce(unit_price <= 0, TRUE)""")
cte("q_inventory_logs", f"""
SELECT *, {_BRONZE}, 'postgresql.inventory_logs' AS source,
       'null product_id or transaction_type' AS quarantine_reason
FROM a_inventory_logs WHERE product_id IS NULL OR transaction_type IS NULL""")
cte("q_reviews", f"""
SELECT *, {_BRONZE}, 'postgresql.reviews' AS source,
       CASE WHEN product_id IS NULL OR user_id IS NULL THEN 'null product_id or user_id'
            ELSE 'null or out-of-range rating (1–5)' END AS quarantine_reason
FROM a_reviews WHERE product_id IS NULL OR user_id IS NULL OR NOT coalesce(rating BETWEEN 1 AND 5, FALSE)""")

# ------------------------------------------------------------------- gold
cte("dim_date", """
SELECT CAST(d AS DATE) AS date_key, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter,
       CAST(month(d) AS INTEGER) AS month, strftime(d, '%B') AS month_name, CAST(day(d) AS INTEGER) AS day,
       CAST(dayofweek(d) + 1 AS INTEGER) AS day_of_week_num, strftime(d, '%A') AS day_of_week_name,
       CAST(weekofyear(d) AS INTEGER) AS week_of_year,
       dayofweek(d) IN (0, 6) AS is_weekend, strftime(d, '%Y-%m') AS year_month
FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d
      FROM (SELECT min(x) AS a, max(x) AS b FROM (
              SELECT CAST(o_orderdate AS DATE) AS x FROM orders UNION ALL SELECT CAST(ts AS DATE) FROM events)))""")

_MONTHS_BETWEEN = f"""
  ((year({AS_OF}) * 12 + month({AS_OF})) - (year(created_at) * 12 + month(created_at))
   + CASE WHEN day({AS_OF}) = day(created_at)
            OR (day({AS_OF}) = day(last_day({AS_OF})) AND day(created_at) = day(last_day(created_at))) THEN 0
          ELSE ((day({AS_OF}) - 1) * 86400 + epoch({AS_OF}) % 86400
                - (day(created_at) - 1) * 86400 - epoch(created_at) % 86400) / 2678400.0 END)"""

cte("dim_users", f"""
SELECT user_id, username, full_name, email, phone, gender, location, created_at AS account_created_at,
       CAST(created_at AS DATE) AS account_created_date, is_active,
       CAST(trunc({_MONTHS_BETWEEN}) AS INTEGER) AS account_age_months
FROM s_users""")

cte("dim_products", f"""
SELECT p.product_id, product_name, brand, category, price AS current_selling_price,
       import_price AS current_unit_cost, {pct_sql('price - import_price', 'price')} AS gross_margin_pct,
       stock_quantity AS current_stock,
       CASE WHEN stock_quantity IS NULL THEN 'Unknown' WHEN stock_quantity < 10 THEN 'Critical'
            WHEN stock_quantity < 20 THEN 'Low' WHEN stock_quantity < 50 THEN 'Medium' ELSE 'Healthy' END AS stock_status,
       is_active, last_restock_date
FROM s_products p LEFT JOIN s_inventory i ON p.product_id = i.product_id""")

cte("dim_promotions", """
SELECT promo_id, promo_code, discount_percent, start_date, end_date,
       CASE WHEN start_date IS NOT NULL AND end_date IS NOT NULL
            THEN CAST(date_diff('day', CAST(start_date AS DATE), CAST(end_date AS DATE)) AS INTEGER) END AS duration_days,
       is_active
FROM s_promotions""")

cte("pay_lookup", """
SELECT * FROM (VALUES ('COD', 'Cash on Delivery', 'Offline', FALSE), ('Credit Card', 'Credit Card', 'Online', TRUE),
  ('E-Wallet', 'Electronic Wallet', 'Online', TRUE), ('Bank Transfer', 'Bank Transfer', 'Online', TRUE))
  AS t(payment_method_code, payment_method_name, payment_channel, is_digital)""")

cte("dim_payment_method", """SELECT * FROM pay_lookup""")

cte("status_lookup", """
SELECT * FROM (VALUES ('Pending', 'Chờ xác nhận', FALSE, FALSE), ('Processing', 'Đang xử lý', FALSE, FALSE),
  ('Shipped', 'Đang giao hàng', FALSE, FALSE), ('Delivered', 'Đã giao hàng', TRUE, FALSE),
  ('Cancelled', 'Đã hủy', FALSE, TRUE), ('Returned', 'Đã hoàn hàng', FALSE, TRUE))
  AS t(status_code, status_name_vi, is_completed, is_negative)""")

cte("dim_order_status", """SELECT * FROM status_lookup""")

cte("fact_orders", """
SELECT order_id, user_id, promo_id, payment_method, order_status, CAST(order_date AS DATE) AS date_key,
       subtotal, shipping_fee, discount_amount, total_amount, total_amount - shipping_fee AS net_revenue,
       order_date AS order_created_at, updated_at
FROM s_orders""")

cte("fact_order_items", f"""
SELECT i.item_id, i.order_id, o.user_id, i.product_id, o.promo_id, o.order_status, o.payment_method,
       CAST(o.order_date AS DATE) AS date_key, i.quantity, i.unit_price, i.unit_cost, i.item_total,
       i.unit_price - i.unit_cost AS unit_gross_profit, (i.unit_price - i.unit_cost) * i.quantity AS line_gross_profit,
       {pct_sql('i.unit_price - i.unit_cost', 'i.unit_price')} AS gross_margin_pct, o.order_date AS order_created_at
FROM s_order_items i LEFT JOIN s_orders o ON i.order_id = o.order_id""")


def alloc_sql(disc, gross, sub):
    return (f"CASE WHEN {sub} > 0 AND {disc} IS NOT NULL THEN CAST((CAST({disc} AS HUGEINT) * {gross} * 2 + {sub}) // (CAST({sub} AS HUGEINT) * 2) AS BIGINT) "
            f"ELSE 0 END")


cte("fs_base", f"""
SELECT i.*, o.user_id, o.promo_id, o.payment_method, o.order_status, o.order_date, o.updated_at, o.subtotal,
       o.shipping_fee, o.discount_amount, o.total_amount, p.product_name, p.brand, p.category,
       i.quantity * i.unit_price AS gross_revenue,
       {alloc_sql('o.discount_amount', 'i.quantity * i.unit_price', 'o.subtotal')} AS allocated_discount
FROM s_order_items i LEFT JOIN s_orders o ON i.order_id = o.order_id
LEFT JOIN s_products p ON i.product_id = p.product_id""")

cte("fact_sales", f"""
SELECT item_id, order_id, user_id, product_id, promo_id, payment_method, order_status,
       CAST(order_date AS DATE) AS date_key, product_name, brand, category, quantity, unit_price, gross_revenue,
       allocated_discount, gross_revenue - allocated_discount AS net_revenue, unit_cost,
       unit_cost * quantity AS total_cost, gross_revenue - allocated_discount - unit_cost * quantity AS gross_profit,
       {pct_sql('gross_revenue - allocated_discount - unit_cost * quantity', 'gross_revenue - allocated_discount')}
         AS gross_margin_pct,
       subtotal AS order_subtotal, shipping_fee, discount_amount AS order_discount_amount,
       total_amount AS order_total_amount, order_date AS order_created_at, updated_at AS order_updated_at
FROM fs_base""")

cte("fact_inventory_log", """
SELECT log_id, product_id, order_id, transaction_type, quantity_changed,
       CASE WHEN transaction_type IN ('IN', 'RETURN') THEN quantity_changed ELSE -quantity_changed END AS quantity_delta,
       note, CAST(created_at AS DATE) AS date_key, created_at AS log_created_at
FROM s_inventory_logs""")

cte("fact_reviews", """
SELECT review_id, product_id, user_id, rating,
       CASE WHEN rating >= 4 THEN 'Positive' WHEN rating = 3 THEN 'Neutral' ELSE 'Negative' END AS sentiment_label,
       comment, comment IS NOT NULL AND trim(comment) <> '' AS has_comment,
       CAST(review_date AS DATE) AS date_key, review_date AS review_created_at
FROM s_reviews""")

# ----------------------------------------------------------- event stream
cte("ev0", f"""
SELECT event_id AS eid, user_id AS uid, event_type AS src_type, ts, value,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       CAST(round(value * 100) AS INTEGER) * 1000 AS base_price,
       CASE WHEN event_type = 'error' THEN CAST((event_id // 7) % 7 AS INTEGER) ELSE -1 END AS reject,
       CASE event_type WHEN 'signup' THEN 'ecommerce.user'
            WHEN 'view' THEN CASE WHEN event_id % 5 = 0 THEN 'ecommerce.review' ELSE 'ecommerce.page_view' END
            WHEN 'click' THEN CASE WHEN event_id % 5 = 0 THEN 'ecommerce.promo' ELSE 'ecommerce.cart' END
            WHEN 'purchase' THEN CASE WHEN event_id % 5 = 0 THEN 'ecommerce.inventory' ELSE 'ecommerce.order' END
            ELSE CASE CAST(event_id % 7 AS INTEGER) {_topic_case} END END AS topic,
       CAST(event_id % 3 AS INTEGER) AS partition, CAST(ts AS TIMESTAMP) AS kafka_timestamp
FROM events""")

cte("ev", f"""
SELECT *,
  CASE WHEN src_type = 'error' THEN CASE topic {_first_type} END
       WHEN topic = 'ecommerce.user' THEN ['user_registered', 'user_login', 'user_logout', 'user_login_attempt',
            'user_login_failed'][CAST(eid % 5 AS INTEGER) + 1]
       WHEN topic = 'ecommerce.page_view' THEN ['page_viewed', 'product_viewed', 'search_performed',
            'category_filtered'][CAST(eid % 4 AS INTEGER) + 1]
       WHEN topic = 'ecommerce.cart' THEN ['item_added', 'item_qty_updated', 'item_removed'][CAST(eid % 3 AS INTEGER) + 1]
       WHEN topic = 'ecommerce.promo' THEN ['promo_applied', 'promo_removed', 'promo_invalid'][CAST((eid // 5) % 3 AS INTEGER) + 1]
       WHEN topic = 'ecommerce.order' THEN CASE WHEN eid % 10 IN (6, 7) THEN 'order_paid'
            WHEN eid % 10 = 8 THEN 'order_cancelled' WHEN eid % 10 = 9 THEN 'order_returned' ELSE 'order_created' END
       WHEN topic = 'ecommerce.inventory' THEN ['stock_updated_out', 'stock_updated_in', 'low_stock_alert',
            'restock_auto', 'restock_manual'][CAST((eid // 5) % 5 AS INTEGER) + 1]
       ELSE 'review_submitted' END AS etype,
  ['ECONOMY', 'STANDARD', 'MEDIUM', 'LARGE', 'SMALL', 'PROMO'][CAST(k % 6 AS INTEGER) + 1] AS category,
  date_trunc('second', CAST(ts AS TIMESTAMP)) AS event_ts,
  'EV' || {_vs('eid')} AS event_id, 'S' || {_vs('uid')} AS session_id,
  CASE WHEN topic = 'ecommerce.page_view' AND uid % 29 = 0 THEN 'anonymous' ELSE 'U' || {_vs('uid')} END AS user_id,
  'Customer ' || {_vs('uid')} AS user_name, 'NATION_' || {_vs('uid % 25')} AS location,
  ['mobile', 'desktop', 'tablet'][CAST(eid % 3 AS INTEGER) + 1] AS device_type,
  ['iOS', 'Android', 'Windows', 'macOS'][CAST(eid % 4 AS INTEGER) + 1] AS os,
  CASE WHEN eid % 50 = 0 THEN 2 ELSE 1 END AS copies
FROM ev0""")

# Good rows (one per event id; the first copy has the lowest offset).
cte("evg", f"""
SELECT *, eid * 2 AS offset, 'ecommerce' AS _ns FROM ev
WHERE reject = -1 AND NOT (topic = 'ecommerce.review' AND eid % 7 IN (0, 6))""")

cte("fact_user_events", f"""
SELECT event_id, etype AS event_type, user_id, 'user' || {_vs('uid')} AS username,
       ['Male', 'Female', 'Other'][CAST(uid % 3 AS INTEGER) + 1] AS gender, location, device_type, os, session_id,
       CAST(event_ts AS DATE) AS date_key, event_ts
FROM evg WHERE topic = 'ecommerce.user'""")

cte("fact_page_views", f"""
SELECT event_id, etype AS event_type, user_id, session_id, device_type, os, location,
       CASE etype WHEN 'page_viewed' THEN 'home' WHEN 'product_viewed' THEN 'product_detail'
            WHEN 'search_performed' THEN 'search' ELSE 'products' END AS page_name,
       CASE WHEN etype = 'product_viewed' THEN 'P' || {_vs('k')} END AS product_id,
       CASE WHEN etype = 'product_viewed' THEN 'Product ' || {_vs('k')} END AS product_name,
       CASE WHEN etype IN ('product_viewed', 'category_filtered') THEN category END AS category,
       CASE WHEN etype = 'product_viewed' THEN 'Brand#' || {_vs('k % 25 + 1')} END AS brand,
       CASE WHEN etype = 'product_viewed' THEN CAST(base_price AS BIGINT) END AS price,
       CASE WHEN etype = 'search_performed' THEN 'item ' || {_vs('k % 10')} END AS search_item,
       CASE WHEN etype = 'search_performed' THEN CAST(k % 7 AS INTEGER) END AS result_count,
       CASE etype WHEN 'product_viewed' THEN 'click' WHEN 'search_performed' THEN 'search_box' END AS trigger,
       CAST(event_ts AS DATE) AS date_key, event_ts
FROM evg WHERE topic = 'ecommerce.page_view'""")

cte("fact_cart_events", f"""
SELECT event_id, etype AS event_type, user_id, session_id, device_type, os, 'P' || {_vs('k')} AS product_id,
       'Product ' || {_vs('k')} AS product_name, 'Brand#' || {_vs('k % 25 + 1')} AS brand, category,
       CAST(base_price AS BIGINT) AS unit_price,
       CAST(CASE etype WHEN 'item_added' THEN 1 WHEN 'item_qty_updated' THEN k % 4 + 2 END AS BIGINT) AS quantity,
       CAST(CASE etype WHEN 'item_added' THEN k % 4 + 1 WHEN 'item_qty_updated' THEN k % 4 + 2 ELSE 0 END AS BIGINT)
         AS cart_quantity_after,
       CAST(k % 4 AS BIGINT) AS old_quantity,
       CAST(CASE etype WHEN 'item_added' THEN k % 4 + 1 WHEN 'item_qty_updated' THEN k % 4 + 2 ELSE 0 END AS BIGINT)
         AS new_quantity,
       CAST(event_ts AS DATE) AS date_key, event_ts
FROM evg WHERE topic = 'ecommerce.cart'""")

cte("fact_promo_events", f"""
SELECT event_id, etype AS event_type, user_id, session_id,
       CASE WHEN etype = 'promo_applied' THEN ['PROMO001', 'PROMO003', 'PROMO002'][CAST(k % 3 AS INTEGER) + 1] END
         AS promo_id,
       CASE etype WHEN 'promo_applied' THEN ['SAVE10', 'SPRING10', 'WELCOME10'][CAST(k % 3 AS INTEGER) + 1]
            WHEN 'promo_removed' THEN 'SAVE10' ELSE 'BAD' || {_vs('k')} END AS promo_code,
       CASE WHEN etype = 'promo_applied' THEN CAST(10.0 AS FLOAT) END AS discount_percent,
       etype = 'promo_applied' AS is_applied, etype = 'promo_invalid' AS is_invalid,
       CAST(event_ts AS DATE) AS date_key, event_ts
FROM evg WHERE topic = 'ecommerce.promo'""")

cte("ord", f"""
SELECT e.*, coalesce(s.sub, 0) AS sub,
       CASE WHEN eid % 9 = 0 THEN NULL WHEN eid % 4 = 1 THEN (coalesce(s.sub, 0) * 10) // 100 ELSE 0 END AS disc
FROM evg e LEFT JOIN (
  SELECT eid AS seid, CAST(sum((1 + (k + j) % 3) * base_price * j) AS BIGINT) AS sub
  FROM (SELECT eid, k, base_price, unnest(generate_series(1, 1 + k % 3)) AS j FROM evg
        WHERE topic = 'ecommerce.order' AND etype = 'order_created' AND k % 23 <> 0) GROUP BY eid) s
ON s.seid = e.eid
WHERE e.topic = 'ecommerce.order'""")

cte("fact_orders_stream", f"""
SELECT event_id, etype AS event_type, 'SO' || {_vs('eid')} AS order_id, user_id, session_id, device_type, os, location,
       CASE WHEN etype = 'order_created' AND eid % 4 = 1 THEN 'PROMO001' END AS promo_id,
       CASE WHEN etype = 'order_created' AND eid % 4 = 1 THEN 'SAVE10' END AS promo_code,
       CASE WHEN etype IN ('order_created', 'order_paid') THEN ['COD', 'Credit Card', 'E-Wallet',
            'Bank Transfer'][CAST(eid % 4 AS INTEGER) + 1] END AS payment_method,
       CASE etype WHEN 'order_created' THEN 'Pending' WHEN 'order_paid' THEN 'Paid'
            WHEN 'order_cancelled' THEN 'Cancelled' ELSE 'Returned' END AS order_status,
       CASE WHEN etype = 'order_created' THEN sub END AS subtotal,
       CAST(CASE WHEN etype = 'order_created' THEN CASE WHEN sub < 10000000 THEN 15000 ELSE 0 END END AS BIGINT)
         AS shipping_fee,
       CASE WHEN etype = 'order_created' THEN coalesce(disc, 0) ELSE 0 END AS discount_amount,
       CASE etype WHEN 'order_created' THEN sub - coalesce(disc, 0) + CASE WHEN sub < 10000000 THEN 15000 ELSE 0 END
            WHEN 'order_paid' THEN CAST(base_price AS BIGINT) END AS total_amount,
       coalesce(CASE WHEN etype = 'order_created' THEN sub - coalesce(disc, 0) END,
                CASE WHEN etype = 'order_paid' THEN CAST(base_price AS BIGINT) END, 0) AS net_revenue,
       CASE WHEN etype = 'order_cancelled' THEN 'changed mind' END AS reason,
       etype = 'order_created' AS is_new_order, etype = 'order_cancelled' AS is_cancelled,
       etype = 'order_returned' AS is_returned, CAST(event_ts AS DATE) AS date_key, event_ts
FROM ord""")

cte("ord_items", f"""
SELECT o.*, 'P' || {_vs('(k + 7 * j) % 100')} AS i_product_id, 'Product ' || {_vs('(k + 7 * j) % 100')} AS i_product_name,
       CAST(1 + (k + j) % 3 AS BIGINT) AS i_quantity, CAST(base_price * j AS BIGINT) AS i_unit_price,
       CAST((base_price * j * 7) // 10 AS BIGINT) AS i_unit_cost
FROM (SELECT *, unnest(generate_series(1, 1 + k % 3)) AS j FROM ord
      WHERE etype = 'order_created' AND k % 23 <> 0) o""")

cte("fact_order_items_stream", f"""
SELECT event_id AS source_event_id, 'SO' || {_vs('eid')} AS order_id, user_id,
       CASE WHEN eid % 4 = 1 THEN 'PROMO001' END AS promo_id, 'Pending' AS order_status,
       ['COD', 'Credit Card', 'E-Wallet', 'Bank Transfer'][CAST(eid % 4 AS INTEGER) + 1] AS payment_method,
       i_product_id AS product_id, i_product_name AS product_name, i_quantity AS quantity,
       i_unit_price AS unit_price, i_unit_cost AS unit_cost, i_quantity * i_unit_price AS item_total,
       i_unit_price - i_unit_cost AS unit_gross_profit, (i_unit_price - i_unit_cost) * i_quantity AS line_gross_profit,
       {pct_sql('i_unit_price - i_unit_cost', 'i_unit_price')} AS gross_margin_pct,
       CAST(event_ts AS DATE) AS date_key, event_ts AS order_ts
FROM ord_items""")

cte("fss_base", f"""
SELECT *, i_quantity * i_unit_price AS gross_revenue, coalesce(disc, 0) AS d0,
       {alloc_sql('coalesce(disc, 0)', 'i_quantity * i_unit_price', 'sub')} AS allocated_discount
FROM ord_items""")

cte("fact_sales_stream", f"""
SELECT event_id AS source_event_id, 'SO' || {_vs('eid')} AS order_id, user_id,
       CASE WHEN eid % 4 = 1 THEN 'PROMO001' END AS promo_id, CASE WHEN eid % 4 = 1 THEN 'SAVE10' END AS promo_code,
       ['COD', 'Credit Card', 'E-Wallet', 'Bank Transfer'][CAST(eid % 4 AS INTEGER) + 1] AS payment_method,
       'Pending' AS order_status, i_product_id AS product_id, i_product_name AS product_name,
       i_quantity AS quantity, i_unit_price AS unit_price, i_unit_cost AS unit_cost, gross_revenue,
       allocated_discount, gross_revenue - allocated_discount AS net_revenue, i_unit_cost * i_quantity AS total_cost,
       gross_revenue - allocated_discount - i_unit_cost * i_quantity AS gross_profit,
       {pct_sql('gross_revenue - allocated_discount - i_unit_cost * i_quantity', 'gross_revenue - allocated_discount')}
         AS gross_margin_pct,
       sub AS order_subtotal, CAST(CASE WHEN sub < 10000000 THEN 15000 ELSE 0 END AS BIGINT) AS shipping_fee,
       d0 AS order_discount_amount,
       sub - d0 + CASE WHEN sub < 10000000 THEN 15000 ELSE 0 END AS order_total_amount,
       CAST(event_ts AS DATE) AS date_key, event_ts AS order_ts
FROM fss_base""")

cte("fact_inventory_events", f"""
SELECT event_id, etype AS event_type, 'P' || {_vs('k')} AS product_id, 'Product ' || {_vs('k')} AS product_name,
       CASE WHEN etype IN ('stock_updated_out', 'stock_updated_in') THEN 'SO' || {_vs('eid')} END AS order_id,
       CAST(CASE etype WHEN 'stock_updated_out' THEN 1 + k % 3 WHEN 'stock_updated_in' THEN 1 + k % 2
            WHEN 'restock_auto' THEN 50 WHEN 'restock_manual' THEN 50 END AS BIGINT) AS quantity_changed,
       CAST(CASE WHEN etype IN ('stock_updated_in', 'restock_auto', 'restock_manual') THEN 1
            WHEN etype = 'stock_updated_out' THEN -1 ELSE 0 END AS INTEGER) AS stock_direction,
       CAST(CASE WHEN etype = 'low_stock_alert' THEN k % 10
            WHEN etype IN ('restock_auto', 'restock_manual') THEN k % 30 + 50 ELSE k % 30 END AS BIGINT) AS stock_remaining,
       etype = 'low_stock_alert' AS is_alert, etype IN ('restock_auto', 'restock_manual') AS is_restock,
       CAST(event_ts AS DATE) AS date_key, event_ts
FROM evg WHERE topic = 'ecommerce.inventory'""")

cte("fact_review_events", f"""
SELECT event_id, etype AS event_type, user_id, 'P' || {_vs('k')} AS product_id, CAST(eid % 7 AS INTEGER) AS rating,
       CASE WHEN eid % 7 >= 4 THEN 'Positive' WHEN eid % 7 = 3 THEN 'Neutral' ELSE 'Negative' END AS sentiment_label,
       CAST((k % 4) * 10 AS INTEGER) AS comment_length, (k % 4) * 10 > 0 AS has_comment,
       CAST(event_ts AS DATE) AS date_key, event_ts
FROM evg WHERE topic = 'ecommerce.review'""")

# Quarantined events: every delivered copy of a bad event (Q4).
cte("quarantine_events", f"""
SELECT CASE WHEN reject IN (0, 6) THEN NULL ELSE event_id END AS event_id,
       CASE WHEN reject IN (4, 6) THEN NULL WHEN reject = 5 THEN 'cart_cleared' ELSE etype END AS event_type,
       CASE WHEN reject IN (1, 6) THEN NULL WHEN reject = 2 THEN '2024-13-45 99:61:00'
            ELSE strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') END AS timestamp,
       CASE WHEN reject IN (3, 6) THEN NULL
            WHEN topic = 'ecommerce.page_view' AND uid % 29 = 0 THEN 'anonymous' ELSE user_id END AS user_id,
       topic AS source_topic,
       CASE reject WHEN 6 THEN 'unparsable json' WHEN 0 THEN 'null event_id' WHEN 1 THEN 'null timestamp'
            WHEN 2 THEN 'bad timestamp' WHEN 3 THEN 'null user_id' WHEN 4 THEN 'null event_type'
            WHEN 5 THEN 'unknown event_type' ELSE 'null or out-of-range rating (1–5)' END AS quarantine_reason,
       topic, partition, eid * 2 + c.copy AS offset, kafka_timestamp, {EV_AS_OF} AS ingested_at
FROM ev, (SELECT unnest([0, 1]) AS copy) c
WHERE c.copy < copies AND (reject >= 0 OR (topic = 'ecommerce.review' AND eid % 7 IN (0, 6)))""")


# ---------------------------------------------------- the raw text of events
def _text(**fields: str) -> list[str]:
    """JSON members of text fields; null (and so left out) where the value is."""
    return [f"""'"{n}":"' || ({v}) || '"'""" for n, v in fields.items()]


def _number(**fields: str) -> list[str]:
    return [f"""'"{n}":' || CAST(({v}) AS VARCHAR)""" for n, v in fields.items()]


def _if(cond: str, value: str) -> str:
    return f"CASE WHEN {cond} THEN {value} END"


_CART_AFTER = "CASE etype WHEN 'item_added' THEN k % 4 + 1 WHEN 'item_qty_updated' THEN k % 4 + 2 ELSE 0 END"
_CREATED = "etype = 'order_created'"
_PRODUCT = {"product_id": f"'P' || {_vs('k')}", "product_name": f"'Product ' || {_vs('k')}"}
_RAW_ENVELOPE = _text(
    event_id="CASE WHEN reject <> 0 THEN event_id END",
    event_type="CASE WHEN reject = 5 THEN 'cart_cleared' WHEN reject <> 4 THEN etype END",
    timestamp="CASE WHEN reject = 2 THEN '2024-13-45 99:61:00' WHEN reject <> 1 THEN strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') END",
    session_id="session_id", user_id="CASE WHEN reject <> 3 THEN user_id END", user_name="' ' || user_name || ' '",
    location="location", device_type="device_type", os="os")
_RAW_PAYLOAD = {
    "ecommerce.user": _text(username=f"' USER' || {_vs('uid')}", gender="['Male', 'Female', 'Other'][CAST(uid % 3 AS INTEGER) + 1]"),
    "ecommerce.page_view": _text(
        page_name="CASE etype WHEN 'page_viewed' THEN 'home' WHEN 'product_viewed' THEN 'product_detail' WHEN 'search_performed' THEN 'search' ELSE 'products' END",
        product_id=_if("etype = 'product_viewed'", _PRODUCT["product_id"]), product_name=_if("etype = 'product_viewed'", _PRODUCT["product_name"]),
        category=_if("etype IN ('product_viewed', 'category_filtered')", "category"),
        brand=_if("etype = 'product_viewed'", f"'Brand#' || {_vs('k % 25 + 1')}"))
        + _number(price=_if("etype = 'product_viewed'", "base_price"))
        + _text(trigger="CASE etype WHEN 'product_viewed' THEN 'click' WHEN 'search_performed' THEN 'search_box' END",
                search_term=_if("etype = 'search_performed'", f"' item ' || {_vs('k % 10')} || ' '"))
        + _number(results_count=_if("etype = 'search_performed'", "k % 7")),
    "ecommerce.cart": _text(**_PRODUCT, brand=f"'Brand#' || {_vs('k % 25 + 1')}", category="category") + _number(
        unit_price="base_price", quantity="CASE etype WHEN 'item_added' THEN 1 WHEN 'item_qty_updated' THEN 2 ELSE -(k % 4) END",
        cart_quantity_after=_CART_AFTER, old_quantity="k % 4", new_quantity=_CART_AFTER),
    "ecommerce.promo": _text(
        promo_id=_if("etype = 'promo_applied'", "['PROMO001', 'PROMO003', 'PROMO002'][CAST(k % 3 AS INTEGER) + 1]"),
        promo_code="CASE etype WHEN 'promo_applied' THEN [' save10 ', 'spring10 ', ' Welcome10'][CAST(k % 3 AS INTEGER) + 1] "
                   f"WHEN 'promo_removed' THEN 'SAVE10' ELSE 'bad' || {_vs('k')} END")
        + _number(discount_percent=_if("etype = 'promo_applied'", "'10.0'")),
    "ecommerce.order": _text(order_id=f"'SO' || {_vs('eid')}") + _number(
        subtotal=_if(_CREATED, "sub"), shipping_fee=_if(_CREATED, "ship"), discount_amount=_if(_CREATED, "disc"),
        total_amount="CASE etype WHEN 'order_created' THEN sub - coalesce(disc, 0) + ship WHEN 'order_paid' THEN base_price END")
        + _text(payment_method=_if("etype IN ('order_created', 'order_paid')", "['COD', 'Credit Card', 'E-Wallet', 'Bank Transfer'][CAST(eid % 4 AS INTEGER) + 1]"),
                promo_id=_if(f"{_CREATED} AND eid % 4 = 1", "'PROMO001'"), promo_code=_if(f"{_CREATED} AND eid % 4 = 1", "'save10'"),
                order_status="CASE etype WHEN 'order_created' THEN 'Pending' WHEN 'order_paid' THEN 'Paid' WHEN 'order_cancelled' THEN 'Cancelled' ELSE 'Returned' END",
                reason=_if("etype = 'order_cancelled'", "' changed mind '"))
        + _number(items="items")
        + _text(product_id=_if("etype = 'order_returned'", _PRODUCT["product_id"]))
        + _number(quantity_returned=_if("etype = 'order_returned'", "1 + k % 2")),
    "ecommerce.inventory": _text(**_PRODUCT, order_id=_if("etype IN ('stock_updated_out', 'stock_updated_in')", f"'SO' || {_vs('eid')}")) + _number(
        quantity_sold=_if("etype = 'stock_updated_out'", "1 + k % 3"), quantity_returned=_if("etype = 'stock_updated_in'", "1 + k % 2"),
        quantity_added=_if("etype IN ('restock_auto', 'restock_manual')", "50"),
        stock_remaining="CASE WHEN etype = 'low_stock_alert' THEN k % 10 WHEN etype IN ('restock_auto', 'restock_manual') THEN k % 30 + 50 ELSE k % 30 END"),
    "ecommerce.review": _text(product_id=_PRODUCT["product_id"]) + _number(rating="eid % 7", comment_length="(k % 4) * 10"),
}
_MEMBERS = " ".join(f"WHEN '{t}' THEN concat_ws(',', {', '.join(_RAW_ENVELOPE + p)})" for t, p in _RAW_PAYLOAD.items())

cte("ev_items", """
SELECT *, CASE WHEN eid % 9 = 0 THEN NULL WHEN eid % 4 = 1 THEN (sub * 10) // 100 ELSE 0 END AS disc, CASE WHEN sub < 10000000 THEN 15000 ELSE 0 END AS ship,
       CASE WHEN bought THEN '[' || array_to_string(list_transform(lines, lambda j: '{"product_id":"P' || CAST((k + 7 * j) % 100 AS VARCHAR)
            || '","product_name":"Product ' || CAST((k + 7 * j) % 100 AS VARCHAR) || '","quantity":' || CAST(1 + (k + j) % 3 AS VARCHAR)
            || ',"unit_price":' || CAST(base_price * j AS VARCHAR) || ',"unit_cost":' || CAST(base_price * j * 7 // 10 AS VARCHAR) || '}'), ',') || ']' END AS items
FROM (SELECT *, CASE WHEN bought THEN CAST(list_sum(list_transform(lines, lambda j: (1 + (k + j) % 3) * CAST(base_price AS BIGINT) * j)) AS BIGINT) ELSE 0 END AS sub
      FROM (SELECT *, topic = 'ecommerce.order' AND etype = 'order_created' AND k % 23 <> 0 AS bought, range(1, 2 + k % 3) AS lines FROM ev))""")

# Every delivered record, with its text.
cte("ev_raw", f"""
SELECT e.*, e.eid * 2 + cp.copy AS offset,
       CASE WHEN reject = 6 THEN '{{"event_id": "EV' || {_vs('eid')} || '", broken' ELSE '{{' || CASE topic {_MEMBERS} END || '}}' END AS json_str
FROM ev_items e, (SELECT unnest([0, 1]) AS copy) cp WHERE cp.copy < copies""")


def with_ctes(final_sql: str) -> str:
    body = ",\n".join(f"{n} AS ({s}\n)" for n, s in CTES)
    return f"WITH {body}\n{final_sql}"


def with_more(extra: str, final_sql: str) -> str:
    """A query over the layers and further CTEs of its own."""
    return with_ctes("").rstrip() + ",\n" + extra + "\n" + final_sql


def table(name: str) -> str:
    return with_ctes(f"SELECT * FROM {name}")
