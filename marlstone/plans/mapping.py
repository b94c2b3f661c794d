"""The given tables in the roles that the marts ask for. Nothing here is made up: every row derives from a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.session import table


def restaurants(spark: SparkSession, d: str) -> DataFrame:
    """Nations as restaurants."""
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("restaurant_id"), F.col("n_name").alias("restaurant_name"))


def orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders of the customer's nation; F is CLOSED."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("restaurant_id"))
    status = F.when(F.col("o_orderstatus") == "F", "CLOSED").when(F.col("o_orderstatus") == "O", "OPEN").otherwise("CANCELLED")
    o = table(spark, d, "orders").join(c, "o_custkey")
    return o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), "restaurant_id", status.alias("order_status"), F.to_date("o_orderdate").alias("date"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Line items; the bonus payment is the discount, the bonus granted the tax."""
    price = F.col("l_extendedprice").cast("decimal(14,2)")
    part = lambda c: (price * F.col(c).cast("decimal(4,2)")).cast("decimal(14,2)")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_linenumber").alias("line"),
        F.col("l_quantity").cast("int").alias("count"), price.alias("total_sum"), part("l_discount").alias("bonus_payment"), part("l_tax").alias("bonus_grant"),
    )


def cities(spark: SparkSession, d: str) -> DataFrame:
    """Nations as places, spread over the globe by their keys; the region tells the time zone."""
    zone = F.get(F.array(*(F.lit(x) for x in ("Africa/Cairo", "America/New_York", "Asia/Tokyo", "Europe/Paris", "Asia/Dubai"))), F.col("n_regionkey"))
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(
        k.alias("city_id"), F.col("n_name").alias("city"), zone.alias("timezone"),
        F.radians((k * 29 % 120 - 60).cast("double")).alias("lat_n_rad"), F.radians((k * 71 % 300 - 150).cast("double")).alias("lng_n_rad"),
    )


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events with a role and, but for every fifth, a place that follows the user and, for most, the week."""
    role = F.when(F.col("event_type").isin("view", "purchase"), "message").when(F.col("event_type").isin("click", "error"), "reaction").otherwise("subscription")
    seed = F.when(F.col("user_id") % 3 == 0, F.col("user_id")).otherwise(F.col("user_id") + F.floor(F.dayofmonth("ts") / F.lit(7.0)))
    off = F.col("user_id") * F.lit(1e-5)
    here = F.col("event_id") % 5 != 0
    e = table(spark, d, "events")
    return e.select(
        "event_id", "user_id", "ts", F.to_date("ts").alias("date"), role.alias("event_type"),
        F.get_json_object("props", "$.k").alias("channel"), ((F.col("user_id") * 7 + F.col("event_id")) % 150).alias("message_to"),
        F.when(here, F.radians((seed * 37 % 120 - 60).cast("double") + off)).alias("lat_rad"),
        F.when(here, F.radians((seed * 53 % 300 - 150).cast("double") + off)).alias("lng_rad"),
    )


def transactions(spark: SparkSession, d: str) -> DataFrame:
    """Line items as transactions of the order's customer, in the supplier's currency; done unless returned."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    li = table(spark, d, "lineitem").join(o, "l_orderkey")
    account = F.when(F.col("o_custkey") % 97 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("operation_id"), account.alias("account_number_from"), (F.col("l_suppkey") % 10).cast("int").alias("currency_code"),
        F.when(F.col("l_returnflag") == "R", "chargeback").otherwise("done").alias("status"), F.col("l_quantity").cast("int").alias("amount"), F.col("o_orderdate").alias("transaction_dt"),
    )


def rates(spark: SparkSession, d: str) -> DataFrame:
    """A rate for each order date and currency but for every seventh day of the month."""
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().where(F.dayofmonth("day") % 7 != 0)
    c = days.select("day", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("currency_code"))
    rate = ((F.col("currency_code") * 31 + F.dayofmonth("day") * 7) % 900 + 100) / F.lit(1000)
    return c.select("currency_code", F.lit(420).alias("currency_code_with"), F.col("day").cast("timestamp").alias("date_update"), rate.cast("decimal(5,3)").alias("currency_with_div"))


def order_rows(spark: SparkSession, d: str) -> DataFrame:
    """Products of orders: order, user, product and category, by line."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(o, "l_orderkey").join(p, "l_partkey")
    text = lambda c: F.col(c).cast("string")
    return li.select(
        text("l_orderkey").alias("order_id"), text("o_custkey").alias("user_id"), F.when(F.col("o_orderstatus") == "F", "CLOSED").otherwise("OPEN").alias("status"),
        F.col("l_linenumber").alias("line"), text("l_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("category_id"), F.col("p_type").alias("category_name"),
    )


def campaigns(spark: SparkSession, d: str) -> DataFrame:
    """Orders as campaigns of thirty days."""
    at = F.unix_timestamp("o_orderdate")
    return table(spark, d, "orders").select(
        (F.col("o_custkey") % 50).cast("string").alias("restaurant_id"), F.col("o_orderkey").cast("string").alias("adv_campaign_id"), F.concat(F.lit("campaign "), F.col("o_orderkey").cast("string")).alias("adv_campaign_content"),
        F.col("o_orderpriority").alias("adv_campaign_owner"), F.concat(F.col("o_custkey").cast("string"), F.lit("@example.com")).alias("adv_campaign_owner_contact"),
        at.alias("adv_campaign_datetime_start"), (at + 30 * 86400).alias("adv_campaign_datetime_end"), at.alias("datetime_created"), F.col("o_orderdate").alias("timestamp"),
    )


def subscriptions(spark: SparkSession, d: str) -> DataFrame:
    """Customers as subscribers."""
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("client_id"), (F.col("c_custkey") % 50).cast("string").alias("restaurant_id"))


def price_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Menus: for each supplier and year of shipping its parts with the year's highest price."""
    li = table(spark, d, "lineitem").where("l_quantity > 0")
    price = F.col("l_extendedprice").cast("decimal(14,2)")
    return li.groupBy(F.col("l_suppkey").alias("restaurant_id"), F.col("l_partkey").alias("product_id"), F.trunc("l_shipdate", "year").cast("timestamp").alias("update_ts")).agg(F.max(price).alias("product_price"))


def restaurant_docs(spark: SparkSession, d: str) -> DataFrame:
    """Nations as restaurant documents; the menu of each is every 25th part."""
    p = table(spark, d, "part")
    item = F.struct(F.col("p_partkey").cast("string").alias("_id"), F.col("p_name").alias("name"), F.col("p_retailprice").cast("decimal(14,2)").alias("price"), F.col("p_type").alias("category"))
    menu = p.groupBy((F.col("p_partkey") % 25).cast("bigint").alias("k")).agg(F.sort_array(F.collect_list(item)).alias("menu"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_nationkey").cast("string").alias("_id"), F.col("n_name").alias("name"))
    return n.join(menu, "k", "left").select("_id", "name", F.coalesce("menu", F.array().cast("array<struct<_id:string,name:string,price:decimal(14,2),category:string>>")).alias("menu"), F.lit("1996-01-01").cast("timestamp").alias("update_ts"))


def user_docs(spark: SparkSession, d: str) -> DataFrame:
    """Customers as user documents."""
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("_id"), F.col("c_name").alias("name"), F.lower("c_name").alias("login"), F.lit("1996-01-01").cast("timestamp").alias("update_ts"))


def order_messages(spark: SparkSession, d: str) -> DataFrame:
    """Orders as JSON messages; every third item has no price, and items have no category, so the menu must tell."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    price = F.when(F.col("l_linenumber") % 3 == 0, F.lit(0)).otherwise(F.col("l_extendedprice")).cast("decimal(19,5)")
    item = F.struct("l_linenumber", F.col("l_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), price.alias("price"), F.col("l_quantity").cast("int").alias("quantity"))
    items = table(spark, d, "lineitem").join(p, "l_partkey").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x.dropFields("l_linenumber")).alias("order_items"))
    o = orders(spark, d).join(items, "order_id")
    payload = F.struct(
        F.struct(F.col("restaurant_id").cast("string").alias("id")).alias("restaurant"), F.col("date").cast("timestamp").alias("date"), F.struct(F.col("user_id").cast("string").alias("id")).alias("user"),
        "order_items", F.lit(5).alias("cost"), F.lit(5).alias("payment"), F.col("order_status").alias("final_status"),
    )
    body = F.struct(F.col("order_id").alias("object_id"), F.lit("order").alias("object_type"), F.col("date").cast("timestamp").alias("sent_dttm"), payload.alias("payload"))
    return o.select(F.to_json(body).alias("value"))
