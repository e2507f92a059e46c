"""Shared CTE prefix: driver tables -> logical source tables -> clean tables -> fact.

oracle query is ``PREFIX + <final SELECT>``; DuckDB drops the CTEs a query
does not reference.
"""

# Logical source tables (FIXTURES.md section 3).
SOURCES = """
src_customers AS (
  SELECT c.c_custkey * 10 + b.b AS customer_id,
         c.c_custkey AS customer_unique_id,
         CAST(10000 + (c.c_nationkey * 37 + b.b * (c.c_custkey % 5)) % 90 AS VARCHAR)
             AS customer_zip_code_prefix,
         n.n_name || '_' || c.c_mktsegment AS customer_city,
         n.n_name AS customer_state
  FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey,
       (SELECT unnest([0, 1, 2]) AS b) b
),
src_orders AS (
  SELECT o_orderkey AS order_id,
         o_custkey * 10 + o_orderkey % 3 AS customer_id,
         CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped'
              ELSE 'canceled' END AS order_status,
         o_orderdate AS order_purchase_timestamp,
         o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS order_approved_at,
         CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE o_orderdate + to_hours(CAST(o_orderkey % 72 AS INTEGER)) END
             AS order_delivered_carrier_date,
         CASE WHEN o_orderkey % 97 = 0 THEN NULL
              ELSE o_orderdate + to_hours(CAST(((o_orderkey * 7) % 125) * 24 + o_orderkey % 24 AS INTEGER))
         END AS order_delivered_customer_date,
         o_orderdate + to_hours(CAST(CASE WHEN o_orderkey % 211 = 0 THEN 150 ELSE 21 END * 24 AS INTEGER))
             AS order_estimated_delivery_date
  FROM orders
),
src_items AS (
  SELECT l_orderkey AS order_id,
         l_linenumber AS order_item_id,
         l_partkey AS product_id,
         l_suppkey AS seller_id,
         l_shipdate AS shipping_limit_date,
         CAST(CASE WHEN l_partkey % 41 = 0 THEN 0 ELSE l_extendedprice END AS DECIMAL(18, 2)) AS price,
         CAST(l_quantity AS DECIMAL(18, 2)) AS freight_value
  FROM lineitem
),
src_products AS (
  SELECT p_partkey AS product_id,
         CASE WHEN p_partkey % 50 = 1 THEN NULL
              ELSE lower(replace(p_brand, '#', '_')) END AS product_category_name,
         CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(20 + p_partkey % 40 AS DOUBLE) END AS product_name_lenght,
         CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE CAST((p_partkey * 7) % 3000 AS DOUBLE) END AS product_description_lenght,
         CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE CAST(1 + p_partkey % 6 AS DOUBLE) END AS product_photos_qty,
         CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS product_weight_g,
         CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_size + 0.5 AS DOUBLE) END AS product_length_cm,
         CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(((p_partkey * 3) % 97) / 4.0 AS DOUBLE) END AS product_height_cm,
         CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(((p_partkey * 13) % 61) / 8.0 AS DOUBLE) END AS product_width_cm
  FROM part
  WHERE p_partkey % 100 <> 0
),
src_sellers AS (
  SELECT s.s_suppkey AS seller_id,
         CAST(20000 + s.s_nationkey AS VARCHAR) AS seller_zip_code_prefix,
         n.n_name AS seller_state
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
),
src_payments AS (
  SELECT l_orderkey AS order_id,
         l_linenumber AS payment_sequential,
         l_partkey AS source_row,
         lower(l_returnflag) AS payment_type,
         l_linenumber AS payment_installments,
         CAST(l_extendedprice AS DECIMAL(18, 2)) AS payment_value
  FROM lineitem
  WHERE l_orderkey % 89 <> 0
),
src_reviews AS (
  SELECT o.o_orderkey AS order_id,
         k.k AS review_no,
         1 + (o.o_orderkey + k.k) % 5 AS review_score,
         CAST(NULL AS VARCHAR) AS review_comment_title,
         CASE WHEN o.o_orderkey % 3 = 0 THEN '' ELSE 'c' || CAST(o.o_orderkey AS VARCHAR) END
             AS review_comment_message,
         o.o_orderdate + to_hours(24 * 25) AS review_creation_date,
         o.o_orderdate + to_hours(24 * 27) AS review_answer_timestamp
  FROM orders o, (SELECT unnest([0, 1]) AS k) k
  WHERE o.o_orderkey % 7 <> 0 AND (k.k = 0 OR o.o_orderkey % 11 = 0)
),
src_geolocation AS (
  SELECT 10000 + (c.c_nationkey * 37 + b.b * (c.c_custkey % 5)) % 90 AS geolocation_zip_code_prefix,
         (c.c_custkey % 180) / 2.0 - 45 AS geolocation_lat,
         (c.c_custkey % 360) / 2.0 - 90 AS geolocation_lng,
         n.n_name || '_' || c.c_mktsegment AS geolocation_city,
         CASE WHEN c.c_custkey % 29 <> 0 THEN n.n_name END AS geolocation_state
  FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey,
       (SELECT unnest([0, 1, 2]) AS b) b
)"""

# Cleaning and the fact (2.4 J1, 2.3 P8-P11).
CLEAN = """
cl_customers AS (SELECT DISTINCT * FROM src_customers),
cl_orders AS (
  SELECT *,
         CAST(floor(datediff('microsecond', order_purchase_timestamp, order_delivered_customer_date)
                    / 86400000000.0) AS BIGINT) AS delivery_time,
         CAST(floor(datediff('microsecond', order_estimated_delivery_date, order_delivered_customer_date)
                    / 86400000000.0) AS BIGINT) AS delay_vs_estimated
  FROM (SELECT DISTINCT * FROM src_orders)
  WHERE order_status = 'delivered' AND order_delivered_customer_date IS NOT NULL
),
cl_items AS (SELECT DISTINCT * FROM src_items),
cl_products_filled AS (
  SELECT product_id,
         coalesce(product_category_name, 'unknown') AS product_category_name,
         product_name_lenght, product_description_lenght, product_photos_qty, product_weight_g, product_length_cm, product_height_cm, product_width_cm
  FROM (SELECT DISTINCT * FROM src_products)
),
cat_median AS (
  SELECT product_category_name,
         median(product_name_lenght) AS med_product_name_lenght,
         median(product_description_lenght) AS med_product_description_lenght,
         median(product_photos_qty) AS med_product_photos_qty,
         median(product_weight_g) AS med_product_weight_g,
         median(product_length_cm) AS med_product_length_cm,
         median(product_height_cm) AS med_product_height_cm,
         median(product_width_cm) AS med_product_width_cm
  FROM cl_products_filled GROUP BY product_category_name
),
cl_products AS (
  SELECT p.product_id, p.product_category_name,
         coalesce(p.product_name_lenght, m.med_product_name_lenght) AS product_name_lenght,
         coalesce(p.product_description_lenght, m.med_product_description_lenght) AS product_description_lenght,
         coalesce(p.product_photos_qty, m.med_product_photos_qty) AS product_photos_qty,
         coalesce(p.product_weight_g, m.med_product_weight_g) AS product_weight_g,
         coalesce(p.product_length_cm, m.med_product_length_cm) AS product_length_cm,
         coalesce(p.product_height_cm, m.med_product_height_cm) AS product_height_cm,
         coalesce(p.product_width_cm, m.med_product_width_cm) AS product_width_cm
  FROM cl_products_filled p JOIN cat_median m USING (product_category_name)
),
category_translation AS (
  SELECT product_category_name,
         CASE WHEN product_category_name = 'brand_2' THEN 'Brand 1'
              ELSE array_to_string(list_transform(string_split(replace(product_category_name, '_', ' '), ' '),
                                                  lambda w: upper(w[1]) || lower(w[2:])), ' ')
         END AS label
  FROM (SELECT DISTINCT product_category_name FROM cl_products)
),
cl_sellers AS (SELECT DISTINCT * FROM src_sellers),
cl_payments AS (SELECT DISTINCT * FROM src_payments),
payments_agg AS (
  SELECT order_id,
         sum(payment_value) AS payment_value,
         max(payment_installments) AS payment_installments,
         max(CASE WHEN rn = 1 THEN payment_type END) AS payment_type
  FROM (SELECT *, row_number() OVER (PARTITION BY order_id
                    ORDER BY payment_sequential, source_row, payment_value, payment_type) AS rn
        FROM cl_payments)
  GROUP BY order_id
),
cl_reviews AS (
  SELECT order_id, review_no, review_score,
         coalesce(review_comment_title, '') AS review_comment_title,
         coalesce(review_comment_message, '') AS review_comment_message,
         review_creation_date, review_answer_timestamp
  FROM (SELECT DISTINCT * FROM src_reviews)
),
fact AS (
  SELECT i.order_id, i.order_item_id, i.product_id, i.seller_id, i.shipping_limit_date,
         i.price, i.freight_value,
         o.customer_id, o.order_status, o.order_purchase_timestamp,
         o.order_approved_at, o.order_delivered_carrier_date,
         o.order_delivered_customer_date, o.order_estimated_delivery_date,
         c.customer_unique_id, c.customer_zip_code_prefix, c.customer_city, c.customer_state,
         p.product_category_name, t.label AS category,
         p.product_name_lenght, p.product_description_lenght, p.product_photos_qty, p.product_weight_g, p.product_length_cm, p.product_height_cm, p.product_width_cm,
         s.seller_zip_code_prefix, s.seller_state,
         pa.payment_value, pa.payment_installments, pa.payment_type,
         r.review_no, r.review_score, r.review_comment_title, r.review_comment_message,
         r.review_creation_date, r.review_answer_timestamp,
         CAST(o.order_purchase_timestamp AS DATE) AS purchase_date,
         CAST(year(o.order_purchase_timestamp) AS BIGINT) AS purchase_year,
         strftime(o.order_purchase_timestamp, '%Y-%m') AS purchase_month,
         CAST(isodow(o.order_purchase_timestamp) - 1 AS BIGINT) AS purchase_weekday,
         o.delivery_time,
         CAST(floor(datediff('microsecond', o.order_purchase_timestamp, o.order_estimated_delivery_date)
                    / 86400000000.0) AS BIGINT) AS estimated_delivery_time,
         o.delay_vs_estimated AS delivery_delay,
         o.delay_vs_estimated,
         i.price + i.freight_value AS item_total,
         CAST(coalesce(length(r.review_comment_message) > 0, false) AS BIGINT) AS has_comment
  FROM cl_items i
  LEFT JOIN cl_orders o ON i.order_id = o.order_id
  LEFT JOIN cl_customers c ON o.customer_id = c.customer_id
  LEFT JOIN cl_products p ON i.product_id = p.product_id
  LEFT JOIN category_translation t ON p.product_category_name = t.product_category_name
  LEFT JOIN cl_sellers s ON i.seller_id = s.seller_id
  LEFT JOIN payments_agg pa ON i.order_id = pa.order_id
  LEFT JOIN cl_reviews r ON i.order_id = r.order_id
),
delivered AS (SELECT * FROM fact WHERE order_status = 'delivered')"""

PREFIX = "WITH " + SOURCES.strip() + "," + CLEAN + "\n"
