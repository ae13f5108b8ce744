"""The ``shop`` table: one row per customer, derived from the star-schema tables.

The analytics run on an 18-column customer table. The test inputs are
order/line-item tables, so each customer is described by their latest line
item (ordered by ship date, then keys) and the number of lines they bought.

Plan shape (scales with lineitem):
  1. ``lineitem`` -> partial + final aggregate on ``l_orderkey``:
     latest line as ``max(struct(...))`` and the line count. Partial
     aggregation runs map-side, so an order with a third of all lines still
     reduces to one row per map task before the shuffle.
  2. join with ``orders`` on the unique order key (no skew possible).
  3. aggregate again on ``o_custkey`` with the same map-side combine;
     a customer owning a third of all orders costs one row per map task.
  4. join ``customer`` (existence only) and ``part`` (attributes); the
     planner picks broadcast or sort-merge from sizes, AQE splits skew.
No window over a customer's lines is used: a window would put a hot
customer's lines into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: fixture domains used to derive shop attributes -----------
FIXTURE_STATES = [
    "California", "New York", "Minnesota", "Virginia", "Texas", "Ohio", "Hawaii",
    "Maine", "Florida", "Illinois", "Maryland", "Alaska", "Georgia", "Washington",
    "Tennessee", "Vermont", "Arizona", "Oregon", "Kentucky", "Montana", "Nevada",
    "Colorado", "Missouri", "Michigan", "Alabama", "Utah", "Arkansas", "Wisconsin",
    "Louisiana", "Iowa", "Oklahoma", "Wyoming", "Mississippi", "Kansas", "Delaware",
    "North Dakota", "New Mexico", "Idaho", "West Virginia", "South Dakota",
    "South Carolina", "Indiana", "North Carolina", "New Hampshire", "Nebraska",
    "Massachusetts", "Connecticut", "Rhode Island", "Pennsylvania", "New Jersey",
]
FIXTURE_PAYMENTS = ["Cash", "Credit Card", "Debit Card", "PayPal", "Venmo", "Bank Transfer"]
FIXTURE_FREQUENCIES = ["Weekly", "Bi-Weekly", "Fortnightly", "Quarterly", "Annually",
                       "Monthly", "Every 3 Months"]
FIXTURE_SHIPPING = {"AF": "Express", "AO": "Free Shipping", "NF": "Next Day Air",
                    "NO": "Standard", "RF": "Store Pickup"}
FIXTURE_OTHER_SHIPPING = "2-Day Shipping"
FIXTURE_SEASONS = ["Winter", "Spring", "Summer", "Fall"]

SHOP_COLUMNS = [
    "customer_id", "age", "gender", "item_purchased", "category",
    "purchase_amount_usd", "location", "size", "color", "season", "review_rating",
    "subscription_status", "shipping_type", "discount_applied", "promo_code_used",
    "previous_purchases", "payment_method", "frequency_of_purchases",
]
STRING_COLUMNS = [
    "gender", "item_purchased", "category", "location", "size", "color", "season",
    "subscription_status", "shipping_type", "discount_applied", "promo_code_used",
    "payment_method", "frequency_of_purchases",
]
NUMERIC_COLUMNS = ["age", "purchase_amount_usd", "review_rating", "previous_purchases"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    """``values[index]`` for a 0-based integer column, from a literal array."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def latest_lines(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Latest line item and line count per customer (steps 1-3 above)."""
    line_key = F.struct(
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus",
    )
    per_order = (
        lineitem.groupBy("l_orderkey")
        .agg(F.max(line_key).alias("last"), F.count(F.lit(1)).alias("n"))
    )
    joined = per_order.join(
        orders.select("o_orderkey", "o_custkey"),
        per_order["l_orderkey"] == orders["o_orderkey"],
    )
    return (
        joined.groupBy("o_custkey")
        .agg(F.max("last").alias("last"), F.sum("n").alias("n_lines"))
        .select("o_custkey", "n_lines", "last.*")
    )


def build_shop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 18-column ``shop`` table over the tables in ``sf_dir``."""
    lineitem = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey")
    part = read_table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size")

    x = latest_lines(lineitem, orders)
    x = x.join(customer, x["o_custkey"] == customer["c_custkey"])
    x = x.join(part, x["l_partkey"] == part["p_partkey"])

    c = F.col("c_custkey")
    disc = F.col("l_discount") >= F.lit(0.05)
    spread = (c * 37) % 1000
    state_idx = F.floor(spread * spread * spread / F.lit(20000000.0))
    flag = F.concat(F.col("l_returnflag"), F.col("l_linestatus"))
    shipping = F.coalesce(
        F.create_map(*[F.lit(v) for kv in FIXTURE_SHIPPING.items() for v in kv])[flag],
        F.lit(FIXTURE_OTHER_SHIPPING),
    )
    return x.select(
        c.alias("customer_id"),
        (F.lit(18) + c % 53).cast("double").alias("age"),
        F.when(c % 3 == 0, "Female").otherwise("Male").alias("gender"),
        F.col("p_brand").alias("item_purchased"),
        F.col("p_type").alias("category"),
        F.col("l_extendedprice").alias("purchase_amount_usd"),
        _pick(FIXTURE_STATES, state_idx).alias("location"),
        F.when(F.col("p_size") < 10, "S").when(F.col("p_size") < 30, "M")
        .when(F.col("p_size") < 42, "L").otherwise("XL").alias("size"),
        F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)).alias("color"),
        _pick(FIXTURE_SEASONS, F.col("l_partkey") % 4).alias("season"),
        ((F.lit(25) + (c * 7) % 26).cast("double") / F.lit(10.0)).alias("review_rating"),
        F.when(disc & ((c * 13) % 100 < 60), "Yes").otherwise("No").alias("subscription_status"),
        shipping.alias("shipping_type"),
        F.when(disc, "Yes").otherwise("No").alias("discount_applied"),
        F.when(disc != (c % 50 == 0), "Yes").otherwise("No").alias("promo_code_used"),
        (F.col("n_lines") - 1).cast("double").alias("previous_purchases"),
        _pick(FIXTURE_PAYMENTS, F.col("l_orderkey") % 6).alias("payment_method"),
        _pick(FIXTURE_FREQUENCIES, F.col("l_orderkey") % 7).alias("frequency_of_purchases"),
    )


# The same table as DuckDB SQL, used only by the oracle side of the checks.
SHOP_SQL = """
WITH line AS (
  SELECT o.o_custkey, o.o_orderkey, l.l_partkey, l.l_extendedprice, l.l_discount,
         l.l_returnflag, l.l_linestatus,
         row_number() OVER (PARTITION BY o.o_custkey
           ORDER BY l.l_shipdate DESC, l.l_orderkey DESC, l.l_linenumber DESC,
                    l.l_partkey DESC, l.l_suppkey DESC, l.l_extendedprice DESC) AS rn,
         count(*) OVER (PARTITION BY o.o_custkey) AS n_lines
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey)
SELECT c.c_custkey AS customer_id,
       CAST(18 + c.c_custkey % 53 AS DOUBLE) AS age,
       CASE WHEN c.c_custkey % 3 = 0 THEN 'Female' ELSE 'Male' END AS gender,
       p.p_brand AS item_purchased,
       p.p_type AS category,
       x.l_extendedprice AS purchase_amount_usd,
       split_part('California,New York,Minnesota,Virginia,Texas,Ohio,Hawaii,Maine,Florida,Illinois,Maryland,Alaska,Georgia,Washington,Tennessee,Vermont,Arizona,Oregon,Kentucky,Montana,Nevada,Colorado,Missouri,Michigan,Alabama,Utah,Arkansas,Wisconsin,Louisiana,Iowa,Oklahoma,Wyoming,Mississippi,Kansas,Delaware,North Dakota,New Mexico,Idaho,West Virginia,South Dakota,South Carolina,Indiana,North Carolina,New Hampshire,Nebraska,Massachusetts,Connecticut,Rhode Island,Pennsylvania,New Jersey', ',',
         1 + CAST(floor(((c.c_custkey*37)%1000)*((c.c_custkey*37)%1000)*((c.c_custkey*37)%1000)/20000000) AS INT)) AS location,
       CASE WHEN p.p_size < 10 THEN 'S' WHEN p.p_size < 30 THEN 'M' WHEN p.p_size < 42 THEN 'L' ELSE 'XL' END AS size,
       split_part(p.p_name, ' ', 1) AS color,
       CASE x.l_partkey % 4 WHEN 0 THEN 'Winter' WHEN 1 THEN 'Spring' WHEN 2 THEN 'Summer' ELSE 'Fall' END AS season,
       CAST(25 + (c.c_custkey*7) % 26 AS DOUBLE) / CAST(10 AS DOUBLE) AS review_rating,
       CASE WHEN x.l_discount >= 0.05 AND (c.c_custkey*13) % 100 < 60 THEN 'Yes' ELSE 'No' END AS subscription_status,
       CASE x.l_returnflag || x.l_linestatus WHEN 'AF' THEN 'Express' WHEN 'AO' THEN 'Free Shipping'
            WHEN 'NF' THEN 'Next Day Air' WHEN 'NO' THEN 'Standard' WHEN 'RF' THEN 'Store Pickup' ELSE '2-Day Shipping' END AS shipping_type,
       CASE WHEN x.l_discount >= 0.05 THEN 'Yes' ELSE 'No' END AS discount_applied,
       CASE WHEN (x.l_discount >= 0.05) <> (c.c_custkey % 50 = 0) THEN 'Yes' ELSE 'No' END AS promo_code_used,
       CAST(x.n_lines - 1 AS DOUBLE) AS previous_purchases,
       split_part('Cash,Credit Card,Debit Card,PayPal,Venmo,Bank Transfer', ',', 1 + CAST(x.o_orderkey % 6 AS INT)) AS payment_method,
       split_part('Weekly,Bi-Weekly,Fortnightly,Quarterly,Annually,Monthly,Every 3 Months', ',', 1 + CAST(x.o_orderkey % 7 AS INT)) AS frequency_of_purchases
FROM line x
JOIN customer c ON c.c_custkey = x.o_custkey
JOIN part p ON p.p_partkey = x.l_partkey
WHERE x.rn = 1
"""
