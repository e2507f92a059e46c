"""DuckDB SQL for every relational query key; ``PREFIX`` defines the fact."""

from oracle.binding import PREFIX

RANGE = "purchase_date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'"

_Q = {}

# --- sales ---------------------------------------------------------------
_Q["revenue_over_time"] = """
SELECT purchase_date AS date, CAST(coalesce(sum(payment_value), 0) AS DOUBLE) AS revenue
FROM delivered WHERE purchase_date IS NOT NULL GROUP BY purchase_date"""

_Q["revenue_by_category"] = """
SELECT category, CAST(coalesce(sum(payment_value), 0) AS DOUBLE) AS revenue
FROM delivered WHERE category IS NOT NULL GROUP BY category"""

_Q["revenue_by_category_range"] = f"""
SELECT category, CAST(coalesce(sum(payment_value), 0) AS DOUBLE) AS revenue
FROM delivered WHERE category IS NOT NULL AND {RANGE} GROUP BY category"""

_Q["top_categories_revenue"] = """
SELECT category, CAST(coalesce(sum(payment_value), 0) AS DOUBLE) AS revenue
FROM delivered WHERE category IS NOT NULL GROUP BY category
ORDER BY revenue DESC, category ASC LIMIT 10"""

_Q["top_categories_volume"] = """
SELECT category, count(order_item_id) AS quantity_sold
FROM delivered WHERE category IS NOT NULL GROUP BY category
ORDER BY quantity_sold DESC, category ASC LIMIT 10"""

_Q["daily_revenue"] = """
SELECT purchase_date AS ds, CAST(coalesce(sum(payment_value), 0) AS DOUBLE) AS y
FROM delivered WHERE purchase_date IS NOT NULL GROUP BY purchase_date"""

_SEASONAL = """
seasonal AS (
  SELECT CASE quarter(purchase_date) WHEN 1 THEN 'Q1 (Jan-Mar)' WHEN 2 THEN 'Q2 (Apr-Jun)'
              WHEN 3 THEN 'Q3 (Jul-Sep)' ELSE 'Q4 (Oct-Dec)' END AS purchase_quarter,
         category, count(order_item_id) AS sales_volume
  FROM delivered WHERE category IS NOT NULL GROUP BY 1, 2)"""

_Q["seasonal_segmentation"] = f", {_SEASONAL} SELECT * FROM seasonal"
_Q["seasonal_segmentation_default"] = f""", {_SEASONAL}
SELECT * FROM seasonal WHERE purchase_quarter = (SELECT max(purchase_quarter) FROM seasonal)"""

# --- customers -----------------------------------------------------------
_Q["customer_loyalty"] = """
, per AS (SELECT customer_unique_id, count(DISTINCT order_id) AS n
          FROM delivered WHERE customer_unique_id IS NOT NULL GROUP BY 1)
SELECT count(*) AS total_customers,
       CAST(coalesce(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS repeat_customers,
       count(*) - CAST(coalesce(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS single_customers,
       CASE WHEN count(*) > 0
            THEN CAST(coalesce(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END), 0) AS DOUBLE) / count(*) * 100
            ELSE 0.0 END AS repeat_rate
FROM per"""

_Q["payment_analysis"] = """
SELECT payment_type, CAST(coalesce(sum(payment_value), 0) AS DOUBLE) AS total_revenue,
       count(DISTINCT order_id) AS order_volume
FROM delivered WHERE payment_type IS NOT NULL GROUP BY payment_type"""

_Q["orders_by_review_score"] = """
SELECT CAST(review_score AS BIGINT) AS review_score, count(DISTINCT order_id) AS total_orders
FROM delivered WHERE review_score IS NOT NULL GROUP BY 1"""

# --- geography -----------------------------------------------------------
_STATE_SALES = """
state_sales AS (
  SELECT customer_state,
         CAST(coalesce(sum(payment_value), 0) AS DOUBLE) AS total_revenue,
         count(DISTINCT order_id) AS total_orders,
         count(DISTINCT customer_id) AS unique_customers
  FROM delivered WHERE customer_state IS NOT NULL {where} GROUP BY customer_state)"""

_Q["sales_by_state"] = ", " + _STATE_SALES.format(where="") + """
SELECT *, total_revenue / total_orders AS avg_order_value FROM state_sales"""

_Q["sales_by_state_range"] = ", " + _STATE_SALES.format(where="AND " + RANGE) + """
SELECT *, total_revenue / total_orders AS avg_order_value FROM state_sales"""

_Q["sales_by_state_kpis"] = ", " + _STATE_SALES.format(where="") + """
SELECT (SELECT count(*) FROM state_sales) AS total_states,
       (SELECT customer_state FROM state_sales ORDER BY total_revenue DESC, customer_state LIMIT 1) AS top_state,
       (SELECT max(total_revenue) FROM state_sales) AS top_state_revenue"""

_Q["top_states"] = ", " + _STATE_SALES.format(where="") + """
SELECT *, total_revenue / total_orders AS avg_order_value FROM state_sales
ORDER BY total_revenue DESC, customer_state LIMIT 15"""

_CUST_DIST = """
SELECT customer_state, unique_customers, total_orders, total_revenue,
       CAST(total_orders AS DOUBLE) / unique_customers AS orders_per_customer,
       total_revenue / unique_customers AS revenue_per_customer
FROM state_sales"""

_Q["customer_distribution"] = ", " + _STATE_SALES.format(where="") + _CUST_DIST
_Q["top_customer_states"] = ", " + _STATE_SALES.format(where="") + _CUST_DIST + """
ORDER BY unique_customers DESC, customer_state LIMIT 15"""

_SELLER = """
seller_perf AS (
  SELECT seller_state,
         count(DISTINCT seller_id) AS unique_sellers,
         count(DISTINCT order_id) AS total_orders,
         CAST(coalesce(sum(payment_value), 0) AS DOUBLE) AS total_revenue,
         CAST(coalesce(sum(price), 0) AS DOUBLE) AS product_value
  FROM delivered WHERE seller_state IS NOT NULL GROUP BY seller_state),
seller_full AS (
  SELECT *, CAST(total_orders AS DOUBLE) / unique_sellers AS avg_orders_per_seller,
         total_revenue / unique_sellers AS avg_revenue_per_seller
  FROM seller_perf)"""

_Q["seller_performance"] = ", " + _SELLER + " SELECT * FROM seller_full"
_Q["top_seller_states"] = ", " + _SELLER + """
SELECT * FROM seller_full ORDER BY total_revenue DESC, seller_state LIMIT 15"""
_Q["seller_kpis"] = ", " + _SELLER + """
SELECT count(*) AS total_seller_states, CAST(sum(unique_sellers) AS BIGINT) AS total_active_sellers,
       round(avg(avg_orders_per_seller), 6) AS avg_orders_per_seller
FROM seller_full"""

_Q["city_analysis"] = """
SELECT customer_city, customer_state,
       count(DISTINCT customer_id) AS customers,
       count(DISTINCT order_id) AS orders,
       CAST(coalesce(sum(payment_value), 0) AS DOUBLE) AS revenue,
       CAST(sum(review_score) AS DOUBLE) / count(review_score) AS avg_review_score,
       CAST(coalesce(sum(payment_value), 0) AS DOUBLE) / count(DISTINCT order_id) AS avg_order_value
FROM delivered WHERE customer_city IS NOT NULL AND customer_state IS NOT NULL
GROUP BY customer_city, customer_state
ORDER BY revenue DESC, customer_city, customer_state LIMIT 20"""

_STATE_CAT = """
state_cat AS (
  SELECT customer_state, category, coalesce(sum(payment_value), 0) AS rev,
         count(DISTINCT order_id) AS orders
  FROM delivered WHERE customer_state IS NOT NULL AND category IS NOT NULL
  GROUP BY customer_state, category),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY customer_state ORDER BY rev DESC, category) AS revenue_rank
  FROM state_cat)"""

_Q["state_top_categories"] = ", " + _STATE_CAT + """
SELECT customer_state, revenue_rank, category, CAST(rev AS DOUBLE) AS revenue, orders
FROM ranked WHERE revenue_rank <= 10"""

_Q["state_vs_national"] = ", " + _STATE_CAT + """,
state_tot AS (SELECT customer_state, sum(rev) AS tot FROM state_cat GROUP BY 1),
nat AS (SELECT category, coalesce(sum(payment_value), 0) AS nrev FROM delivered WHERE category IS NOT NULL GROUP BY 1),
nat_tot AS (SELECT sum(nrev) AS ntot FROM nat)
SELECT r.customer_state, r.revenue_rank, r.category,
       CAST(r.rev AS DOUBLE) / CAST(t.tot AS DOUBLE) * 100 AS state_pct,
       CAST(n.nrev AS DOUBLE) / CAST((SELECT ntot FROM nat_tot) AS DOUBLE) * 100 AS national_pct,
       CAST(r.rev AS DOUBLE) / CAST(t.tot AS DOUBLE) * 100
         - CAST(n.nrev AS DOUBLE) / CAST((SELECT ntot FROM nat_tot) AS DOUBLE) * 100 AS difference
FROM ranked r JOIN state_tot t USING (customer_state) JOIN nat n USING (category)
WHERE r.revenue_rank <= 10"""

_Q["distinct_states"] = """
SELECT DISTINCT customer_state FROM delivered WHERE customer_state IS NOT NULL ORDER BY 1"""

# --- delivery ------------------------------------------------------------
_KPIS = """
SELECT avg(delivery_time) AS avg_delivery_time, avg(delivery_delay) AS avg_delay,
       avg(CASE WHEN delivery_delay <= 0 THEN 1 ELSE 0 END) * 100 AS on_time_pct,
       avg(CASE WHEN delivery_delay > 0 THEN 1 ELSE 0 END) * 100 AS late_pct
FROM delivered {where}"""
_Q["delivery_kpis"] = _KPIS.format(where="")
_Q["delivery_kpis_range"] = _KPIS.format(where="WHERE " + RANGE)

_Q["delivery_time_histogram"] = """
, bins AS (SELECT * FROM (VALUES (0, '0-7 days', 0, 7), (1, '8-14 days', 7, 14),
            (2, '15-21 days', 14, 21), (3, '22-28 days', 21, 28), (4, '29-35 days', 28, 35),
            (5, '35+ days', 35, 100)) v(bin_id, time_range, lo, hi))
SELECT b.bin_id, b.time_range,
       (SELECT count(*) FROM delivered d WHERE d.delivery_time > b.lo AND d.delivery_time <= b.hi) AS row_count
FROM bins b"""

_Q["monthly_delay"] = """
SELECT purchase_month AS month, avg(delivery_delay) AS avg_delay,
       avg(delivery_time) AS avg_delivery_time, count(order_id) AS order_count
FROM delivered WHERE purchase_month IS NOT NULL GROUP BY purchase_month"""

_Q["delay_categories"] = """
, bins AS (SELECT * FROM (VALUES (0, 'On Time', -100, 0), (1, '1-7 days late', 0, 7),
            (2, '8-14 days late', 7, 14), (3, '15-30 days late', 14, 30),
            (4, '30+ days late', 30, 100)) v(bin_id, category, lo, hi)),
counted AS (
  SELECT b.bin_id, b.category,
         (SELECT count(*) FROM delivered d WHERE d.delivery_delay > b.lo AND d.delivery_delay <= b.hi)
           AS row_count
  FROM bins b),
tot AS (SELECT sum(row_count) AS t FROM counted),
q AS (SELECT c.*, t.t, (c.row_count * 10000) // t.t AS q, (c.row_count * 10000) % t.t AS r
      FROM counted c, tot t)
SELECT bin_id, category, row_count,
       CASE WHEN t > 0 THEN
         CAST(q + CASE WHEN 2 * r > t OR (2 * r = t AND q % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 100.0
       END AS percentage
FROM q"""

_Q["delivery_by_state"] = """
SELECT customer_state, avg(delivery_time) AS avg_delivery_time, avg(delivery_delay) AS avg_delay,
       count(order_id) AS orders
FROM delivered WHERE customer_state IS NOT NULL GROUP BY customer_state
ORDER BY orders DESC, customer_state LIMIT 15"""

_Q["freight_kpis"] = """
SELECT CAST(sum(freight_value) AS DOUBLE) / CAST(count(freight_value) AS DOUBLE) AS avg_freight,
       CAST(coalesce(sum(freight_value), 0) AS DOUBLE) AS total_freight,
       round(avg(CASE WHEN price = 0 THEN NULL
                      ELSE CAST(freight_value AS DOUBLE) / CAST(price AS DOUBLE) END) * 100, 6)
         AS freight_ratio_pct
FROM delivered"""

_Q["freight_by_category"] = """
SELECT category,
       CAST(sum(freight_value) AS DOUBLE) / CAST(count(freight_value) AS DOUBLE) AS avg_freight,
       CAST(coalesce(sum(freight_value), 0) AS DOUBLE) AS total_freight,
       count(order_id) AS orders
FROM delivered WHERE category IS NOT NULL GROUP BY category
ORDER BY total_freight DESC, category LIMIT 15"""


# --- fraud ---------------------------------------------------------------
_FRAUD = """
seq AS (
  SELECT *, row_number() OVER (
           PARTITION BY customer_unique_id
           ORDER BY order_purchase_timestamp NULLS FIRST, order_id NULLS FIRST, order_item_id NULLS FIRST,
                    product_id NULLS FIRST, seller_id NULLS FIRST, price NULLS FIRST, review_no NULLS FIRST,
                    freight_value NULLS FIRST, shipping_limit_date NULLS FIRST) AS order_sequence
  FROM fact WHERE customer_unique_id IS NOT NULL),
firsts AS (SELECT customer_unique_id, payment_value AS v1, customer_zip_code_prefix AS z1
           FROM seq WHERE order_sequence = 1),
pairs AS (
  SELECT s.customer_unique_id, s.order_id, CAST(s.order_item_id AS BIGINT) AS order_item_id, s.product_id,
         s.order_sequence,
         CAST(s.payment_value AS DOUBLE) AS order_value_current, CAST(f.v1 AS DOUBLE) AS order_value_first,
         s.customer_zip_code_prefix AS zip_current, f.z1 AS zip_first,
         CAST(s.payment_value AS DOUBLE) / (CAST(f.v1 AS DOUBLE) + 1.0) AS value_ratio,
         coalesce(s.customer_zip_code_prefix <> f.z1, true) AS different_zip
  FROM seq s JOIN firsts f USING (customer_unique_id)
  WHERE s.order_sequence >= 2),
scored AS (
  SELECT *, CAST(CASE WHEN value_ratio >= 5 AND different_zip THEN 100
                      WHEN value_ratio >= 5 THEN 75
                      WHEN value_ratio >= 3 AND value_ratio < 5 AND different_zip THEN 50
                      ELSE 0 END AS BIGINT) AS fraud_score
  FROM pairs),
cases AS (
  SELECT *, CASE WHEN fraud_score >= 0 AND fraud_score <= 80 THEN 'High Risk'
                 WHEN fraud_score > 80 AND fraud_score <= 99 THEN 'Very High Risk'
                 WHEN fraud_score > 99 AND fraud_score <= 100 THEN 'Critical Risk' END AS risk_level
  FROM scored WHERE fraud_score >= 75)"""

_Q["fraud_pairs"] = ", " + _FRAUD + " SELECT * FROM pairs"
_Q["fraud_scored"] = ", " + _FRAUD + " SELECT * FROM scored"
_Q["fraud_cases"] = ", " + _FRAUD + " SELECT * FROM cases"
_Q["fraud_count"] = ", " + _FRAUD + " SELECT count(*) AS fraud_cases FROM cases"
_Q["fraud_top20"] = ", " + _FRAUD + """
SELECT order_id, customer_unique_id, order_value_current, order_value_first, value_ratio, different_zip,
       risk_level
FROM cases ORDER BY value_ratio DESC, customer_unique_id, order_sequence LIMIT 20"""
_Q["order_sequence"] = ", " + _FRAUD + """
SELECT s.customer_unique_id, s.order_id, CAST(s.order_item_id AS BIGINT) AS order_item_id, s.product_id,
       s.seller_id, CAST(s.review_no AS BIGINT) AS review_no, s.order_sequence,
       CAST(f.v1 AS DOUBLE) AS first_order_value, f.z1 AS first_customer_zip_code_prefix
FROM seq s JOIN firsts f USING (customer_unique_id)"""

# --- churn ---------------------------------------------------------------
_DAYS = "CAST(floor(datediff('microsecond', {a}, {b}) / 86400000000.0) AS BIGINT)"
_CHURN = """
crows AS (
  SELECT customer_unique_id, order_id, order_item_id, payment_type, review_score, item_total,
         CAST(purchase_date AS TIMESTAMP) AS purchase_ts,
         """ + _DAYS.format(a="CAST(purchase_date AS TIMESTAMP)", b="order_delivered_customer_date") + """ AS delivery_days,
         """ + _DAYS.format(a="order_estimated_delivery_date", b="order_delivered_customer_date") + """ AS delay_days
  FROM delivered),
bounds AS (SELECT max(purchase_ts) AS end_ts, max(purchase_ts) - INTERVAL 90 DAY AS cutoff FROM crows),
label AS (
  SELECT customer_unique_id,
         """ + _DAYS.format(a="max(purchase_ts)", b="(SELECT end_ts FROM bounds)") + """ AS days_since_last
  FROM crows WHERE customer_unique_id IS NOT NULL GROUP BY 1),
feat AS (SELECT * FROM crows
         WHERE customer_unique_id IS NOT NULL AND purchase_ts <= (SELECT cutoff FROM bounds)),
cust AS (
  SELECT customer_unique_id,
         count(DISTINCT order_id) AS num_orders,
         CAST(coalesce(sum(item_total), 0) AS DOUBLE) AS total_spent,
         CAST(sum(item_total) AS DOUBLE) / count(item_total) AS avg_order_value,
         CAST(sum(review_score) AS DOUBLE) / nullif(count(review_score), 0) AS avg_review,
         CAST(sum(delivery_days) AS DOUBLE) / nullif(count(delivery_days), 0) AS avg_delivery_days,
         CAST(sum(delay_days) AS DOUBLE) / nullif(count(delay_days), 0) AS avg_delay,
         count(order_item_id) AS total_items,
         max(purchase_ts) AS last_ts, min(purchase_ts) AS first_ts,
         count(DISTINCT CASE WHEN purchase_ts >= (SELECT cutoff FROM bounds) - INTERVAL 30 DAY THEN order_id END)
           AS orders_last_30d,
         count(DISTINCT CASE WHEN purchase_ts >= (SELECT cutoff FROM bounds) - INTERVAL 60 DAY THEN order_id END)
           AS orders_last_60d,
         count(DISTINCT CASE WHEN purchase_ts >= (SELECT cutoff FROM bounds) - INTERVAL 90 DAY THEN order_id END)
           AS orders_last_90d
  FROM feat GROUP BY 1),
late AS (
  SELECT customer_unique_id, avg(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS pct_late
  FROM (SELECT customer_unique_id, order_id, avg(delay_days) AS d FROM feat GROUP BY 1, 2) GROUP BY 1),
gap_rows AS (
  SELECT customer_unique_id,
         datediff('day', lag(purchase_ts) OVER (PARTITION BY customer_unique_id ORDER BY purchase_ts),
                  purchase_ts) AS g
  FROM feat),
gaps AS (
  -- mean and sample standard deviation of the gaps: sqrt((k*S2 - S1^2) / (k*(k-1)))
  SELECT customer_unique_id,
         CASE WHEN count(g) >= 1 THEN CAST(sum(g) AS DOUBLE) / count(g) END AS avg_days_between,
         CASE WHEN count(g) >= 2 THEN
           sqrt(CAST(CAST(count(g) AS HUGEINT) * sum(CAST(g AS HUGEINT) * g) - CAST(sum(g) AS HUGEINT) * sum(g)
                     AS DOUBLE) / CAST(count(g) * (count(g) - 1) AS DOUBLE)) END AS std_days_between
  FROM gap_rows GROUP BY 1),
pay AS (
  SELECT customer_unique_id, payment_type AS preferred_payment FROM (
    SELECT customer_unique_id, payment_type,
           row_number() OVER (PARTITION BY customer_unique_id ORDER BY count(*) DESC, payment_type) AS rn
    FROM feat WHERE payment_type IS NOT NULL GROUP BY 1, 2)
  WHERE rn = 1),
features AS (
  SELECT c.customer_unique_id, c.num_orders, c.total_spent,
         coalesce(c.avg_order_value, 0.0) AS avg_order_value, coalesce(c.avg_review, 0.0) AS avg_review,
         coalesce(c.avg_delivery_days, 0.0) AS avg_delivery_days, coalesce(c.avg_delay, 0.0) AS avg_delay,
         c.total_items,
         """ + _DAYS.format(a="c.last_ts", b="(SELECT cutoff FROM bounds)") + """ AS recency,
         """ + _DAYS.format(a="c.first_ts", b="(SELECT cutoff FROM bounds)") + """ + 1 AS tenure_days,
         coalesce(g.avg_days_between, 0.0) AS avg_days_between,
         coalesce(g.std_days_between, 0.0) AS std_days_between,
         c.orders_last_30d, c.orders_last_60d, c.orders_last_90d,
         coalesce(l.pct_late, 0.0) AS pct_late,
         c.first_ts,
         coalesce(p.preferred_payment, 'unknown') AS preferred_payment,
         coalesce(CAST(lb.days_since_last > 90 AS BIGINT), 0) AS churn
  FROM cust c
  LEFT JOIN pay p USING (customer_unique_id)
  LEFT JOIN gaps g USING (customer_unique_id)
  LEFT JOIN late l USING (customer_unique_id)
  LEFT JOIN label lb USING (customer_unique_id))"""

_Q["churn_label"] = ", " + _CHURN + """
SELECT customer_unique_id, days_since_last, CAST(days_since_last > 90 AS BIGINT) AS churn FROM label"""
_Q["churn_features"] = ", " + _CHURN + " SELECT * FROM features"
_Q["purchase_gaps"] = ", " + _CHURN + " SELECT * FROM gaps"
_Q["recent_orders"] = ", " + _CHURN + """
SELECT customer_unique_id, orders_last_30d, orders_last_60d, orders_last_90d FROM features"""
_Q["pct_late_by_customer"] = ", " + _CHURN + " SELECT customer_unique_id, pct_late FROM features"


# --- profiles, cleaning steps, lookups -------------------------------------
_SRC_COLUMNS = {
    "customers": ["customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city",
                  "customer_state"],
    "orders": ["order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
               "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date"],
    "order_items": ["order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date", "price",
                    "freight_value"],
    "payments": ["order_id", "payment_sequential", "source_row", "payment_type", "payment_installments",
                 "payment_value"],
    "reviews": ["order_id", "review_no", "review_score", "review_comment_title", "review_comment_message",
                "review_creation_date", "review_answer_timestamp"],
    "products": ["product_id", "product_category_name", "product_name_lenght", "product_description_lenght",
                 "product_photos_qty", "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm"],
    "sellers": ["seller_id", "seller_zip_code_prefix", "seller_state"],
    "geolocation": ["geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng", "geolocation_city",
                    "geolocation_state"],
}
_SRC_CTE = {"order_items": "src_items"}

_Q["table_profile"] = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, CAST({len(cols)} AS BIGINT) AS column_count "
    f"FROM {_SRC_CTE.get(t, 'src_' + t)}" for t, cols in _SRC_COLUMNS.items())

# Spark's names of the columns' types, where they differ from text
_SRC_TYPES = {
    "bigint": "customers.customer_id customers.customer_unique_id orders.order_id orders.customer_id order_items.order_id "
              "order_items.product_id order_items.seller_id payments.order_id payments.source_row reviews.order_id "
              "reviews.review_score products.product_id sellers.seller_id geolocation.geolocation_zip_code_prefix",
    "int": "order_items.order_item_id payments.payment_sequential payments.payment_installments reviews.review_no",
    "decimal(18,2)": "order_items.price order_items.freight_value payments.payment_value",
    "double": "geolocation.geolocation_lat geolocation.geolocation_lng",
}
_TYPE_OF = {c: t for t, cs in _SRC_TYPES.items() for c in cs.split()}


def _type(table: str, column: str) -> str:
    if column.endswith(("_timestamp", "_date", "_at")):
        return "timestamp_ntz"
    if table == "products" and column not in ("product_id", "product_category_name"):
        return "double"
    return _TYPE_OF.get(f"{table}.{column}", "string")


_Q["column_profile"] = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, CAST({i} AS BIGINT) AS position, '{c}' AS column_name, '{_type(t, c)}' AS data_type, "
    f"count(*) AS row_count, count({c}) AS non_null FROM {_SRC_CTE.get(t, 'src_' + t)}"
    for t, cols in _SRC_COLUMNS.items() for i, c in enumerate(cols, 1))

_Q["null_profile"] = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS null_count "
    f"FROM {_SRC_CTE.get(t, 'src_' + t)}" for t, cols in _SRC_COLUMNS.items() for c in cols)

_Q["fact_preview"] = """
SELECT order_id, CAST(order_item_id AS BIGINT) AS order_item_id, product_id, seller_id,
       CAST(review_no AS BIGINT) AS review_no, order_status, customer_state, category,
       CAST(payment_value AS DOUBLE) AS payment_value
FROM fact
ORDER BY order_id NULLS FIRST, order_item_id NULLS FIRST, product_id NULLS FIRST, seller_id NULLS FIRST,
         price NULLS FIRST, review_no NULLS FIRST, freight_value NULLS FIRST, shipping_limit_date NULLS FIRST
LIMIT 20"""

_Q["build_fact"] = """
SELECT * REPLACE (CAST(price AS DOUBLE) AS price, CAST(freight_value AS DOUBLE) AS freight_value,
                  CAST(payment_value AS DOUBLE) AS payment_value, CAST(item_total AS DOUBLE) AS item_total,
                  CAST(order_item_id AS BIGINT) AS order_item_id, CAST(review_no AS BIGINT) AS review_no,
                  CAST(payment_installments AS BIGINT) AS payment_installments)
FROM fact"""

_Q["dedup_items"] = """
SELECT DISTINCT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS order_item_id FROM lineitem"""

_DATE_STRINGS = """
date_strings AS (
  SELECT o_orderkey AS order_id,
         CASE WHEN o_orderkey % 13 = 0 THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END
           AS raw_ts
  FROM orders)"""
_Q["parse_dates"] = """
SELECT o_orderkey AS order_id, strptime(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS parsed_ts
FROM orders"""
_Q["coerce_dates"] = ", " + _DATE_STRINGS + """
SELECT order_id, try_strptime(raw_ts, '%Y-%m-%d %H:%M:%S') AS parsed_ts FROM date_strings"""

_Q["fill_text"] = """
SELECT product_id, coalesce(product_category_name, 'unknown') AS product_category_name
FROM (SELECT DISTINCT * FROM src_products)"""
_Q["impute_group_median"] = "SELECT * FROM cl_products"
_Q["geolocation_clean"] = """
SELECT DISTINCT * REPLACE (CAST(geolocation_zip_code_prefix AS VARCHAR) AS geolocation_zip_code_prefix)
FROM src_geolocation"""
_Q["category_label"] = """
SELECT p.product_id, p.product_category_name, t.label AS category
FROM cl_products p LEFT JOIN category_translation t ON p.product_category_name = t.product_category_name"""
_Q["payments_per_order"] = """
SELECT order_id, CAST(payment_value AS DOUBLE) AS payment_value,
       CAST(payment_installments AS BIGINT) AS payment_installments, payment_type
FROM payments_agg"""
_Q["orders_with_items"] = """
SELECT order_id FROM cl_orders WHERE order_id IN (SELECT order_id FROM cl_items)"""
_Q["calendar_columns"] = """
SELECT order_id, CAST(order_purchase_timestamp AS DATE) AS purchase_date,
       CAST(year(order_purchase_timestamp) AS BIGINT) AS purchase_year,
       strftime(order_purchase_timestamp, '%Y-%m') AS purchase_month,
       CAST(isodow(order_purchase_timestamp) - 1 AS BIGINT) AS purchase_weekday
FROM cl_orders"""
_Q["delivery_days"] = """
SELECT order_id, delivery_time,
       """ + _DAYS.format(a="order_purchase_timestamp", b="order_estimated_delivery_date") + """
         AS estimated_delivery_time,
       """ + _DAYS.format(a="order_estimated_delivery_date", b="order_delivered_customer_date") + """
         AS delivery_delay,
       delay_vs_estimated
FROM cl_orders"""
_Q["has_comment"] = """
SELECT order_id, CAST(review_no AS BIGINT) AS review_no,
       CAST(coalesce(length(review_comment_message) > 0, false) AS BIGINT) AS has_comment
FROM cl_reviews"""
_Q["date_bounds"] = "SELECT min(purchase_date) AS min_date, max(purchase_date) AS max_date FROM delivered"
_Q["customer_search"] = ", " + _CHURN + """
SELECT customer_unique_id, num_orders, recency, total_spent FROM features
WHERE regexp_matches(CAST(customer_unique_id AS VARCHAR), '12', 'i')
ORDER BY customer_unique_id LIMIT 20"""
_Q["customer_card"] = ", " + _CHURN + """
SELECT customer_unique_id, num_orders, recency, total_spent, churn FROM features
WHERE customer_unique_id = (SELECT min(customer_unique_id) FROM features)"""
_Q["churn_customer_count"] = ", " + _CHURN + " SELECT count(*) AS total_customers FROM features"
_Q["churn_matrix"] = ", " + _CHURN + """
SELECT * EXCLUDE (first_ts, preferred_payment),
       CAST(preferred_payment = 'a' AS BIGINT) AS pay_a, CAST(preferred_payment = 'n' AS BIGINT) AS pay_n,
       CAST(preferred_payment = 'r' AS BIGINT) AS pay_r, CAST(preferred_payment = 'unknown' AS BIGINT) AS pay_unknown
FROM features"""
_Q["churn_split_counts"] = ", " + _CHURN + """,
sizes AS (SELECT churn, count(*) AS n, CAST(round(count(*) * 0.2) AS BIGINT) AS test FROM features GROUP BY churn)
SELECT churn, 'test' AS split, test AS customers FROM sizes WHERE test > 0
UNION ALL SELECT churn, 'train', n - test FROM sizes WHERE n > test"""

# --- forecast KPIs on a given frame ------------------------------------------
_Q["forecast_metrics_given"] = """
, dr AS (SELECT purchase_date AS ds, CAST(coalesce(sum(payment_value), 0) AS DOUBLE) AS y
         FROM delivered WHERE purchase_date IS NOT NULL GROUP BY 1),
act AS (SELECT * FROM dr WHERE ds <= (SELECT max(ds) FROM dr) - INTERVAL 180 DAY),
lst AS (SELECT max(ds) AS last_ds, arg_max(y, ds) AS last_y FROM act),
fut AS (SELECT dr.ds, dr.y AS yhat FROM dr, lst WHERE dr.ds > lst.last_ds),
tot AS (SELECT count(*) AS forecast_days, round(sum(yhat), 2) AS total_forecast,
               arg_max(yhat, ds) AS final_forecast FROM fut),
monthly AS (SELECT date_trunc('month', ds) AS month, sum(yhat) AS month_yhat FROM fut GROUP BY 1),
peak AS (SELECT month, month_yhat FROM monthly ORDER BY month_yhat DESC, month LIMIT 1)
SELECT 'total' AS series, forecast_days, total_forecast,
       (final_forecast - last_y) / last_y * 100 AS predicted_growth_pct,
       strftime(month, '%b %Y') AS peak_month, round(month_yhat, 2) AS peak_revenue
FROM tot, lst, peak"""

_Q["risk_tier"] = ", " + _CHURN + """
SELECT customer_unique_id, pct_late AS probability,
       CASE WHEN pct_late >= 0.8 THEN 'VERY HIGH RISK' WHEN pct_late >= 0.6 THEN 'HIGH RISK'
            WHEN pct_late >= 0.4 THEN 'MONITOR' ELSE 'SAFE' END AS risk_level
FROM features"""
_Q["state_top_categories_state"] = ", " + _STATE_CAT + """
SELECT customer_state, revenue_rank, category, CAST(rev AS DOUBLE) AS revenue, orders
FROM ranked WHERE revenue_rank <= 10 AND customer_state = 'NATION_1'"""
_Q["state_vs_national_state"] = _Q["state_vs_national"] + " AND r.customer_state = 'NATION_1'"

def _full(body: str) -> str:
    body = body.strip()
    if body.startswith(","):
        # extra CTEs continue the shared WITH list
        return PREFIX.rstrip() + body
    return PREFIX + body


ORACLE = {k: _full(v) for k, v in _Q.items()}
