"""Queries over the given tables, one per operator or mart, with their oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone import schemas
from marlstone.functions import ids, times
from marlstone.operators import messages, places, upsert, warehouse
from marlstone.operators.filters import changed
from marlstone.plans import mapping as M
from marlstone.plans import loads, marts
from marlstone.plans import oracles as O
from marlstone.session import shared_dir, table
from marlstone.sources import keyed
from marlstone.streaming import campaigns, orders

QUERIES: dict = {}
ORACLES: dict = {}
NOW = 826848000  # 1996-03-15, a fixed clock for campaigns


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


@query("mart01_settlement", O.SETTLEMENT)
def _(spark: SparkSession, d: str) -> DataFrame:
    return marts.settlement(M.facts(spark, d), M.orders(spark, d), M.restaurants(spark, d), "1996-01-01", "1999-12-31")


@query("mart02_users", O.USERS)
def _(spark, d):
    m = marts.users_mart(M.events(spark, d), M.cities(spark, d))
    return m.withColumn("travel_array", F.array_join("travel_array", ">"))


@query("mart03_zones", O.ZONES)
def _(spark, d):
    return marts.zones_mart(M.events(spark, d), M.cities(spark, d))


@query("mart04_recommendations", O.RECOMMENDATIONS)
def _(spark, d):
    return marts.recommendations_mart(M.events(spark, d), M.cities(spark, d)).drop("processed_dttm")


@query("mart05_currency_metrics", O.CURRENCY)
def _(spark, d):
    m = marts.currency_metrics(M.transactions(spark, d), M.rates(spark, d))
    return m.withColumn("amount_total", F.col("amount_total").cast("double"))


@query("mart06_user_products", O.USER_PRODUCTS)
def _(spark, d):
    return marts.product_counters(messages.event_rows(messages.order_events(_order_products(spark, d))))


@query("mart07_user_categories", O.USER_CATEGORIES)
def _(spark, d):
    return marts.category_counters(messages.event_rows(messages.order_events(_order_products(spark, d))))


@query("mart08_notifications", O.NOTIFICATIONS)
def _(spark, d):
    return campaigns.notifications(M.campaigns(spark, d), M.subscriptions(spark, d), F.lit(NOW))


def _order_products(spark, d):
    """The last line of each product of an order."""
    return warehouse.last_in_order(M.order_rows(spark, d), "order_id", "product_id", "line")


@query("jn03_nearest_place", O.NEAREST)
def _(spark, d):
    return places.nearest_place(M.events(spark, d), M.cities(spark, d)).select("event_id", "city_id", "city")


@query("wn05_stays", O.STAYS)
def _(spark, d):
    e = places.nearest_place(M.events(spark, d).where("event_type = 'message'"), M.cities(spark, d))
    return places.stays(e).select("user_id", "city_id", "stay_start", "stay_end", "stay_start_ts", F.col("stay_len").cast("bigint").alias("stay_len"))


@query("wn10_fill_reference", O.FILL_REFERENCE)
def _(spark, d):
    e = places.fill_place(places.nearest_place(M.events(spark, d), M.cities(spark, d)))
    return e.select("event_id", "city_id", "added_city")


@query("wn11_fill_nearest_time", O.FILL_TIME)
def _(spark, d):
    e = places.fill_place(places.nearest_place(M.events(spark, d), M.cities(spark, d)), "nearest_time")
    return e.select("event_id", "city_id", "added_city")


@query("jn04_co_subscribers", O.CO_SUBSCRIBERS)
def _(spark, d):
    return places.co_subscribers(M.events(spark, d))


@query("jn05_uncontacted_pairs", O.UNCONTACTED)
def _(spark, d):
    e = M.events(spark, d)
    return places.co_subscribers(e, without=places.contacts(e))


@query("prj11_hub_keys", O.HUB_KEYS)
def _(spark, d):
    return warehouse.hub(table(spark, d, "orders"), "o_orderkey").select("pk", "business_id")


@query("prj12_link_keys", O.LINK_KEYS)
def _(spark, d):
    return warehouse.link(table(spark, d, "orders"), "o_orderkey", "o_custkey").select("pk", "left_pk", "right_pk")


@query("wh09_satellite", O.SATELLITE)
def _(spark, d):
    o = table(spark, d, "orders")
    return warehouse.satellite(o, "o_custkey", ["o_orderstatus", "o_totalprice"], ["o_orderdate", "o_orderkey"]).drop("load_dt", "load_src")


@query("dst03_last_in_order", O.LAST_IN_ORDER)
def _(spark, d):
    return _order_products(spark, d).select("order_id", "product_id", F.col("line").cast("int").alias("line"))


@query("prj04_time_dimension", O.TIME_DIMENSION)
def _(spark, d):
    return warehouse.time_dimension(table(spark, d, "orders"), "o_orderdate")


@query("prj19_local_time", O.LOCAL_TIME)
def _(spark, d):
    e = places.nearest_place(M.events(spark, d), M.cities(spark, d)).where("city_id IS NOT NULL")
    return e.select("event_id", times.local_time(F.col("ts"), F.col("timezone")).alias("local_time"), times.week_of(F.col("date")).alias("week"), times.month_of(F.col("date")).alias("month"))


@query("snk06_upsert", O.UPSERT)
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return upsert.upsert(o.where("o_orderdate < '1998-01-01'").dropDuplicates(["o_orderkey"]), o.where("o_orderdate >= '1997-01-01'").withColumn("o_orderstatus", F.concat("o_orderstatus", F.lit("2"))), ["o_orderkey"], ["o_orderdate"])


@query("snk07_insert_absent", O.INSERT_ABSENT)
def _(spark, d):
    o = table(spark, d, "orders")
    hubs = lambda df: df.groupBy("o_custkey").agg(F.min("o_orderdate").alias("load_dt"))
    return upsert.insert_absent(hubs(o.where("o_orderdate >= '1999-01-01'")), o.select("o_custkey", F.col("o_orderdate").alias("load_dt")), ["o_custkey"], ["load_dt"])


@query("snk08_add_counts", O.ADD_COUNTS)
def _(spark, d):
    o = table(spark, d, "orders")
    count = lambda df: df.groupBy("o_custkey").agg(F.count("*").alias("order_cnt"))
    return upsert.add_counts(count(o.where("o_orderdate < '1998-01-01'")), count(o.where("o_orderdate >= '1998-01-01'")), ["o_custkey"], "order_cnt")


@query("wh02_scd1", O.SCD1)
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("ts"), "o_orderkey", "o_orderstatus")
    first = upsert.latest(o.where("ts < '1997-01-01'"), ["id"], ["ts", "o_orderkey"])
    return upsert.scd1(first, o.where("ts >= '1997-01-01'"), ["id"], ["o_orderstatus"], ["ts", "o_orderkey"])


def _stored(df: DataFrame) -> DataFrame:
    """A table of its own in the shared folder, for loads that read it on several ways."""
    at = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", keyed.CODEC).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


@query("wh04_scd2", O.SCD2)
def _(spark, d):
    s = _stored(M.price_snapshots(spark, d))
    early = s.where("update_ts < '1998-01-01'")
    empty = s.limit(0).select("restaurant_id", "product_id", "product_price", F.col("update_ts").alias("active_from"), F.col("update_ts").alias("active_to"))
    stored = _stored(upsert.scd2(empty, early, "restaurant_id", ["product_id"], ["product_price"], "update_ts"))
    return upsert.scd2(stored, s.where("update_ts >= '1998-01-01'"), "restaurant_id", ["product_id"], ["product_price"], "update_ts")


@query("jn13_as_of", O.AS_OF)
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    versions = table(spark, d, "lineitem").groupBy("l_partkey", F.trunc("l_shipdate", "month").cast("timestamp").alias("active_from")).agg(F.max("l_suppkey").alias("version"))
    versions = versions.where("month(active_from) % 3 = 1").withColumn("active_to", F.expr("active_from + INTERVAL 400 DAY"))
    return warehouse.as_of_join(li, versions, ["l_partkey"], "l_shipdate")


@query("jn15_menu_diff", O.MENU_DIFF)
def _(spark, d):
    s = M.price_snapshots(spark, d)
    return warehouse.menu_diff(s.where("update_ts = '1996-01-01'"), s.where("update_ts = '1997-01-01'"), ["restaurant_id", "product_id"])


@query("flt11_changed", O.CHANGED)
def _(spark, d):
    s = lambda y: M.price_snapshots(spark, d).where(f"update_ts = '{y}-01-01'")
    return changed(s(1997), s(1996), ["restaurant_id", "product_id"], ["product_price"])


@query("wh01_incremental", O.INCREMENTAL)
def _(spark, d):
    """Two loads of the whole table: of its first half of keys as it stood then, and of all that lies beyond the stored mark."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    then = o.where(F.col("o_orderkey") <= (warehouse.high_mark(o, "o_orderkey") or 0) // 2)
    state, loaded = spark.createDataFrame([], warehouse.MARKS), []
    for run, stored in enumerate((then, o), 1):
        mark = warehouse.read_mark(state, "orders")
        batch = warehouse.incremental_batch(stored, "o_orderkey", mark if mark is None else int(mark))
        loaded.append(batch.withColumn("run", F.lit(run)))
        state = warehouse.write_mark(state, "orders", warehouse.high_mark(batch, "o_orderkey"))
    return loaded[0].unionByName(loaded[1]).withColumn("mark", F.lit(warehouse.read_mark(state, "orders")).cast("long"))


@query("wh06_pending_orders", O.PENDING)
def _(spark, d):
    o = M.orders(spark, d)
    stamps = warehouse.time_dimension(o.where("month(date) <> 2"), "date")
    users = o.where("user_id % 11 <> 0").select("user_id")
    _, pending = warehouse.resolve_orders(o.where("restaurant_id IS NOT NULL"), M.restaurants(spark, d).where("restaurant_id <> 3"), stamps, users)
    return pending.select("order_id", F.array_join("missing", ",").alias("missing"))


@query("dq01_checks", O.CHECKS)
def _(spark, d):
    li = table(spark, d, "lineitem")
    rules = {"discount": F.col("l_discount") < 0.09, "quantity": F.col("l_quantity").between(2, 49), "price": F.col("l_extendedprice") > 0}
    return warehouse.violations(li, rules, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", F.array_join("failed", ",").alias("failed"))


@query("dq03_duplicates", O.DUPLICATES)
def _(spark, d):
    return warehouse.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("dq04_orphans", O.ORPHANS)
def _(spark, d):
    parents = table(spark, d, "orders").where("o_orderstatus <> 'P'")
    return warehouse.orphans(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey"), parents, ["o_orderkey"])


@query("snk10_canonical_json", O.CANONICAL)
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_custkey")
    return messages.canonical_json(o, "o_orderkey", "o_orderdate").select("object_id", "object_value")


@query("prj13_order_items", O.ORDER_ITEMS)
def _(spark, d):
    """Orders as documents in JSON text, parsed and exploded again."""
    o = M.facts(spark, d).join(M.orders(spark, d), "order_id")
    item = F.struct(F.col("product_id").cast("string").alias("id"), F.lit("x").alias("name"), F.col("total_sum").alias("price"), F.col("count").alias("quantity"))
    docs = o.groupBy("order_id").agg(F.max("order_status").alias("final_status"), F.max("date").alias("date"), F.collect_list(item).alias("order_items"))
    docs = docs.select(F.col("order_id").cast("string").alias("_id"), "final_status", "date", "order_items")
    good, _ = messages.parse(docs.select(F.to_json(F.struct(*docs.columns)).alias("object_value")), "object_value", schemas.ORDER_DOC)
    return messages.order_items(good).groupBy("order_id").agg(F.count("*").alias("n"), F.sum("total_sum").cast("double").alias("total"))


@query("wh07_sales_fact", O.SALES)
def _(spark, d):
    f = M.facts(spark, d).join(M.orders(spark, d), "order_id")
    items = f.groupBy("order_id", "product_id").agg(F.max("order_status").alias("final_status"), F.max("date").cast("timestamp").alias("date"), F.sum("count").cast("int").alias("count"), F.max("total_sum").alias("price"), F.sum("total_sum").cast("decimal(14,2)").alias("total_sum"))
    products = table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.lit("1999-01-01").cast("timestamp").alias("active_from"), F.lit("2099-12-31").cast("timestamp").alias("active_to"))
    bonuses = M.facts(spark, d).where("product_id % 2 = 0").select("order_id", "product_id", "bonus_payment", "bonus_grant")
    return warehouse.sales_fact(items, products, bonuses).select("order_id", "product_id", "count", F.col("total_sum").cast("double").alias("total_sum"), F.col("bonus_payment").cast("double").alias("bonus_payment"), F.col("bonus_grant").cast("double").alias("bonus_grant"))


@query("stm07_running_counters", O.RUNNING)
def _(spark, d):
    """Orders as a file stream, counted in the state store; each batch's keys are merged until the stream is drained."""
    at = f"{shared_dir(spark)}/counters-{uuid.uuid4().hex}"
    raw = spark.readStream.schema("o_custkey bigint").option("recursiveFileLookup", "true").parquet(f"{d.rstrip('/')}/orders.parque[t]")
    orders.count_into(raw, ["o_custkey"], f"{at}/table", f"{at}/marks", trigger={"availableNow": True}).awaitTermination()
    return keyed.read(spark, f"{at}/table")


@query("ids_uuid3", O.UUID3)
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", ids.uuid3(F.concat_ws("_", "p_name", "p_brand")).alias("key"))


QUERIES |= loads.QUERIES
ORACLES |= loads.ORACLES
