"""Parsing, quarantine, explosion and emission of JSON documents and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone import schemas
from marlstone.functions.ids import hub_key


#: Fixed value: the type of the events that counters count.
ORDER_EVENT = "cdm_order_event"
#: Fixed value: how landed documents write times.
STAMP = "yyyy-MM-dd HH:mm:ss"


def bodies(raw: DataFrame, column: str, schema: str) -> tuple[DataFrame, Column]:
    """The rows with the fields of a JSON column in ``_body``, and what tells those whose text is no such JSON."""
    if schema.startswith("array"):
        body = F.from_json(column, schema)
        bad = F.col("_body").isNull()
    else:
        body = F.from_json(column, schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
        bad = F.col("_body").isNull() | F.col("_body._bad").isNotNull()
    # as an element that is exploded the body is parsed once; a filter would be pushed below it and parse again
    return raw.select("*", F.explode(F.array(body)).alias("_body")), bad


def parse(raw: DataFrame, column: str, schema: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(parsed, dead letters): the fields of a JSON column, and the rows whose text is no such JSON."""
    rows, bad = bodies(raw, column, schema)
    dead = rows.where(bad).drop("_body")
    good = rows.where(~bad)
    if schema.startswith("array"):
        return good.select(*keep, F.col("_body").alias("items")), dead
    return good.select(*keep, "_body.*").drop("_bad"), dead


def order_items(orders: DataFrame) -> DataFrame:
    """One row for each item of an order document, with its total."""
    items = orders.select(F.col("_id").alias("order_id"), "final_status", "date", "update_ts", F.explode("order_items").alias("i"))
    total = (F.col("i.quantity") * F.col("i.price")).cast("decimal(14,2)")
    return items.select("order_id", "final_status", "date", "update_ts", F.col("i.id").alias("product_id"), F.col("i.quantity").alias("count"), F.col("i.price").alias("price"), total.alias("total_sum"))


def order_rows(orders: DataFrame) -> DataFrame:
    """Dimension rows of parsed order documents."""
    return orders.select(F.col("_id").alias("order_id"), F.col("restaurant.id").alias("restaurant_id"), F.col("user.id").alias("user_id"), "date", F.col("final_status").alias("order_status"), "update_ts")


def user_rows(users: DataFrame) -> DataFrame:
    """Dimension rows of parsed user documents."""
    return users.select(F.col("_id").alias("user_id"), F.col("name").alias("user_name"), F.col("login").alias("user_login"), "update_ts")


def restaurant_rows(restaurants: DataFrame) -> DataFrame:
    """Dimension rows of parsed restaurant documents."""
    return restaurants.select(F.col("_id").alias("restaurant_id"), F.col("name").alias("restaurant_name"), "update_ts")


def bonus_items(events: DataFrame) -> DataFrame:
    """One row for each product payment of a parsed bonus event."""
    return events.select("order_id", F.explode("product_payments").alias("p")).select(
        "order_id", F.col("p.product_id").alias("product_id"), F.col("p.bonus_payment").alias("bonus_payment"), F.col("p.bonus_grant").alias("bonus_grant")
    )


def menu_items(restaurants: DataFrame) -> DataFrame:
    """One row for each product of a restaurant's menu."""
    return restaurants.select(F.col("_id").alias("restaurant_id"), "update_ts", F.explode("menu").alias("m")).select(
        "restaurant_id", F.col("m._id").alias("product_id"), F.col("m.name").alias("product_name"), F.col("m.price").alias("product_price"), "update_ts"
    )


def canonical_json(df: DataFrame, id_column: str, ts_column: str) -> DataFrame:
    """Raw landing rows (object_id, object_value, update_ts): keys sorted, fixed timestamp format, ids as strings."""
    fields = [F.col(c).cast("string").alias(c) if c == id_column else F.col(c) for c in sorted(df.columns)]
    text = F.to_json(F.struct(*fields), {"timestampFormat": STAMP, "timestampNTZFormat": STAMP})
    return df.select(F.col(id_column).cast("string").alias("object_id"), text.alias("object_value"), F.col(ts_column).alias("update_ts"))


def enrich_orders(messages: DataFrame, restaurants: DataFrame, users: DataFrame, key: str | None = None) -> DataFrame:
    """Order messages in the next stage's shape: names looked up, a missing or zero price taken from the menu.

    Unknown restaurants, users and items keep their row with nulls. The dimensions join by equality, so Spark
    broadcasts them if they are small and shuffles otherwise. Without ``key`` each order is put together again by all its
    fields, which go along with each item, and messages that are the same in all of them give one row. With ``key``, a
    column that no message lacks and no two share, only the key goes along, and what was found comes back to the messages.
    """
    names = restaurants.select(F.col("_id").alias("_rid"), F.col("name").alias("rname"))
    people = users.select(F.col("_id").alias("_uid"), F.col("name").alias("uname"), "login")
    menu = restaurants.select(F.col("_id").alias("mrid"), F.explode("menu").alias("m")).select("mrid", F.col("m._id").alias("mid"), "m.price", "m.category")
    price = lambda i, of: F.coalesce(F.nullif(i["price"], F.lit(0)), of).cast("decimal(19,5)")
    product = lambda i, p, c: F.struct(i["id"].alias("id"), price(i, p).alias("price"), i["quantity"].alias("quantity"), i["name"].alias("name"), F.coalesce(c, i["category"]).alias("category"))
    o = messages.select("object_id", "object_type", "payload.*").withColumns({"rid": F.col("restaurant.id"), "uid": F.col("user.id")})
    if key is None:
        # the message's other fields go along with each of its items, so messages are read and parsed once
        head = ["object_id", "object_type", "date", "cost", "payment", "final_status", "rid", "uid", "_items"]
        items = o.withColumn("_items", F.xxhash64("order_items")).select(*head, F.posexplode_outer("order_items").alias("pos", "i"))
        items = items.join(menu, (F.col("rid") == F.col("mrid")) & (F.col("i.id") == F.col("mid")), "left")
        found = F.struct("pos", product(F.col("i"), F.col("price"), F.col("category")).alias("p"))
        o = items.groupBy(*head).agg(F.array_sort(F.collect_set(F.when(F.col("pos").isNotNull(), found))).alias("ps"))
        o = o.select(*head, F.when(F.size("ps") > 0, F.transform("ps", lambda x: x["p"])).alias("products"))
        o = o.join(names, F.col("rid") == F.col("_rid"), "left").join(people, F.col("uid") == F.col("_uid"), "left")
    else:
        menu = menu.groupBy("mrid", "mid").agg(F.array_sort(F.collect_set(F.struct("price", "category"))).alias("ms"))
        items = o.select(key, "rid", F.posexplode(F.transform("order_items", lambda i: i["id"])).alias("pos", "iid"))
        items = items.join(menu, (F.col("rid") == F.col("mrid")) & (F.col("iid") == F.col("mid")), "left")
        items = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "ms"))).alias("_found"))  # as long as order_items
        who = o.select(key, "rid", "uid").join(names, F.col("rid") == F.col("_rid"), "left").join(people, F.col("uid") == F.col("_uid"), "left").select(key, "rname", "uname", "login")
        none, amount = F.lit(None), menu.schema["ms"].dataType.elementType["price"].dataType
        at = lambda x, n: F.get("_found", n)["ms"]
        each = lambda x, n: F.when(at(x, n).isNull(), F.array(product(x, none.cast(amount), none.cast("string")))).otherwise(F.array_sort(F.array_distinct(F.transform(at(x, n), lambda m: product(x, m["price"], m["category"])))))
        o = o.join(items, key, "left").join(who, key)
        o = o.withColumn("products", F.when(F.size("order_items") > 0, F.flatten(F.transform("order_items", each))))
    payload = F.struct(
        F.col("object_id").alias("id"),
        "date",
        "cost",
        "payment",
        F.col("final_status").alias("status"),
        F.struct(F.col("rid").alias("id"), F.col("rname").alias("name")).alias("restaurant"),
        F.struct(F.col("uid").alias("id"), F.col("uname").alias("name"), "login").alias("user"),
        "products",
    )
    return o.select("object_id", "object_type", payload.alias("payload"))


def emitted(df: DataFrame, *columns: str, key: str | None = None) -> DataFrame:
    """A sink row: value as JSON of the columns (all by default), and a key if one is named."""
    value = F.to_json(F.struct(*(columns or df.columns))).alias("value")
    return df.select(value) if key is None else df.select(F.col(key).cast("string").alias("key"), value)


def order_events(orders: DataFrame) -> DataFrame:
    """For each CLOSED order one message: a JSON array with an element for each of its products.

    ``orders`` has order_id, user_id, status and, row by row, product_id, product_name, category_id, category_name.
    """
    closed = orders.where(F.col("status") == "CLOSED")
    payload = F.struct("order_id", "user_id", "product_id", "product_name", "category_id", "category_name")
    event = F.struct(F.col("order_id").alias("object_id"), F.lit(ORDER_EVENT).alias("object_type"), payload.alias("payload"))
    return closed.groupBy("order_id").agg(F.to_json(F.sort_array(F.collect_list(event))).alias("value"))


def whole_order_events(orders: DataFrame) -> DataFrame:
    """As ``order_events``, of orders with an array of their products (id, name, category) in one row each: order_id, value."""
    ids = ("order_id", "user_id")
    payload = lambda p: F.struct(*ids, p["id"].alias("product_id"), p["name"].alias("product_name"), hub_key(p["category"]).alias("category_id"), p["category"].alias("category_name"))
    event = lambda p: F.struct(F.col("order_id").alias("object_id"), F.lit(ORDER_EVENT).alias("object_type"), payload(p).alias("payload"))
    closed = orders.where((F.col("status") == "CLOSED") & (F.size("products") > 0))
    return closed.select("order_id", F.to_json(F.sort_array(F.transform("products", event))).alias("value"))


def event_rows(messages: DataFrame, column: str = "value") -> DataFrame:
    """The payloads of order event arrays, one row each; elements of any other type are passed over."""
    e = messages.select(F.explode(F.from_json(column, schemas.ORDER_EVENTS)).alias("e"))
    return e.where((F.col("e.object_type") == ORDER_EVENT) & F.col("e.payload").isNotNull()).select("e.payload.*")


def actor(event_type: Column, event: str = "event") -> Column:
    """Whoever did the event, as a string: the user, the one who reacted or the sender."""
    return (
        F.when(event_type == "subscription", F.col(f"{event}.user").cast("string"))
        .when(event_type == "reaction", F.col(f"{event}.reaction_from").cast("string"))
        .when(event_type == "message", F.col(f"{event}.message_from").cast("string"))
    )
