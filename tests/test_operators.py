"""Operators on small literal tables: nulls, ties, repeats, empty tables and the golden values of the contracts."""

import datetime as dt
import io
import json
import os
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from marlstone import schemas
from marlstone.functions import geo, ids, money
from marlstone.operators import filters, messages, places, upsert, warehouse
from marlstone.plans import marts
from marlstone.sources import files, sinks

T = lambda s: dt.datetime.fromisoformat(s)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


GOLDEN = {
    "7608298": "2a86e8a3-faae-37c2-9cb6-70af837dd42f",
    "97a91f3df3b44224bb8d67a4": "b5ed2502-4f0d-3dc6-9a39-22cd6038acbf",
    "22a38d8dbb584051b8b72f15": "5fef8f39-d458-3793-a1ee-a3333506ecc4",
    "d3275d9d9530440ea2b0be23": "25f98706-7d86-3388-bfba-ea8376a8bbe1",
    "Супы": "9b6bbc10-93eb-34e4-947d-97fe9f716803",
}


def test_uuid3_golden(spark):
    df = spark.createDataFrame([(k,) for k in GOLDEN] + [(None,)], "id string")
    got = {r.id: r.key for r in df.select("id", ids.hub_key(F.col("id")).alias("key")).collect()}
    assert got.pop(None) is None
    assert got == GOLDEN


def test_order_total_golden(spark):
    doc = {"_id": "1", "final_status": "CLOSED", "order_items": [{"id": "a", "price": 641, "quantity": 5}, {"id": "b", "price": 169, "quantity": 5}]}
    raw = spark.createDataFrame([(json.dumps(doc),), ("{broken",), (None,)], "v string")
    good, dead = messages.parse(raw, "v", schemas.ORDER_DOC)
    assert dead.count() == 2
    assert float(messages.order_items(good).agg(F.sum("total_sum")).first()[0]) == 4050


def test_settlement_fee_edges(spark):
    df = spark.createDataFrame([(100, 0), (100, 80), (100, 75), (100, 74)], "t int, b int").select(F.col("t").cast("decimal(14,2)"), F.col("b").cast("decimal(14,2)"))
    got = df.select(money.processing_fee(F.col("t"), F.col("b")), money.reward(F.col("t"), F.col("b"))).collect()
    assert [tuple(map(float, r)) for r in got] == [(25, 75), (0, 20), (0, 25), (25, 1)]


def test_upsert_last_wins_and_twice_is_once(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, ts int")
    batch = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, None, 1), (3, None, 1), (None, "n", 1)], "k int, v string, ts int")
    once = upsert.upsert(target, batch, ["k"], ["ts"])
    assert rows(once) == sorted([(1, "a", 1), (2, "d", 3), (3, None, 1), (None, "n", 1)], key=repr)
    assert rows(upsert.upsert(once, batch, ["k"], ["ts"])) == rows(once)
    assert rows(upsert.upsert(target, batch.limit(0), ["k"], ["ts"])) == rows(target)


def test_insert_absent_keeps_stored(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    batch = spark.createDataFrame([(1, "z"), (2, "b"), (2, "c")], "k int, v string")
    assert rows(upsert.insert_absent(target, batch, ["k"])) == [(1, "a"), (2, "b")]


def test_add_counts_carries_names(spark):
    target = spark.createDataFrame([(1, "old", 2)], "k int, name string, n long")
    delta = spark.createDataFrame([(1, "new", 3), (2, "x", 1)], "k int, name string, n long")
    assert rows(upsert.add_counts(target, delta, ["k"], "n", ["name"])) == [(1, "new", 5), (2, "x", 1)]


def test_scd1_keeps_first_dates(spark):
    target = spark.createDataFrame([(1, "a", 10)], "id int, name string, active_from int")
    batch = spark.createDataFrame([(1, "b", 20), (2, "c", 20)], "id int, name string, active_from int")
    assert rows(upsert.scd1(target, batch, ["id"], ["name"], ["active_from"])) == [(1, "b", 10), (2, "c", 20)]


MENU = "restaurant_id string, product_id string, price int, update_ts timestamp"
DIM = "restaurant_id string, product_id string, price int, active_from timestamp, active_to timestamp"


def scd2(current, batch):
    return upsert.scd2(current, batch, "restaurant_id", ["product_id"], ["price"], "update_ts")


def test_scd2_versions(spark):
    empty = spark.createDataFrame([], DIM)
    t1, t2, t3 = T("2024-01-01"), T("2024-02-01"), T("2024-03-01")
    batch = spark.createDataFrame(
        [("r", "a", 1, t1), ("r", "b", 5, t1), ("r", "a", 2, t2), ("r", "a", 2, t3), ("r", "b", 5, t3), ("q", "z", 9, t2)], MENU
    )
    first, end = T("1999-01-01"), T("2099-12-31")
    want = [
        ("q", "z", 9, first, end), ("r", "a", 1, first, t2), ("r", "a", 2, t2, end), ("r", "b", 5, first, t2), ("r", "b", 5, t3, end),
    ]
    whole = scd2(empty, batch)
    assert rows(whole) == sorted(want, key=repr)
    # in two batches, and again, the history is the same
    parts = scd2(scd2(empty, batch.where(F.col("update_ts") < F.lit(t2))), batch.where(F.col("update_ts") >= F.lit(t2)))
    assert rows(parts) == rows(whole)
    assert rows(scd2(whole, batch)) == rows(whole)
    # intervals of a key never overlap
    a, b = whole.alias("a"), whole.alias("b")
    clash = a.join(b, (F.col("a.product_id") == F.col("b.product_id")) & (F.col("a.active_from") < F.col("b.active_from")) & (F.col("b.active_from") < F.col("a.active_to")))
    assert clash.count() == 0
    assert upsert.current_versions(whole, ["product_id"], F.lit(t3)).count() == 3


def test_as_of_bounds(spark):
    dim = spark.createDataFrame([(1, "v1", T("2024-01-01"), T("2024-02-01")), (1, "v2", T("2024-02-01"), T("2099-12-31"))], "k int, v string, active_from timestamp, active_to timestamp")
    facts = spark.createDataFrame([(1, T("2023-12-31")), (1, T("2024-01-01")), (1, T("2024-02-01")), (2, T("2024-02-01"))], "k int, ts timestamp")
    got = warehouse.as_of_join(facts, dim, ["k"], "ts").select("k", "ts", "v")
    assert rows(got) == rows(spark.createDataFrame([(1, T("2023-12-31"), None), (1, T("2024-01-01"), "v1"), (1, T("2024-02-01"), "v2"), (2, T("2024-02-01"), None)], "k int, ts timestamp, v string"))


def test_pending_orders_name_all_that_is_missing(spark):
    orders = spark.createDataFrame([(1, 1, 1, "d1"), (2, 9, 9, "d9"), (3, None, 1, "d1")], "order_id int, restaurant_id int, user_id int, date string")
    good, pending = warehouse.resolve_orders(
        orders, spark.createDataFrame([(1,)], "restaurant_id int"), spark.createDataFrame([("d1",)], "ts string"), spark.createDataFrame([(1,)], "user_id int")
    )
    assert [r.order_id for r in good.collect()] == [1]
    assert {r.order_id: list(r.missing) for r in pending.collect()} == {2: ["restaurant", "timestamp", "user"], 3: ["restaurant"]}


def test_marks(spark):
    state = spark.createDataFrame([], warehouse.MARKS)
    assert warehouse.read_mark(state, "p", "0") == "0"
    state = warehouse.write_mark(warehouse.write_mark(state, "p", 5), "q", 7)
    assert warehouse.read_mark(state, "p") == "5"
    assert warehouse.next_launch(warehouse.write_mark(state, "launch:x", 3), "x") == 4
    df = spark.range(10)
    assert warehouse.high_mark(warehouse.incremental_batch(df, "id", 3, 2), "id") == 5
    assert warehouse.high_mark(df.limit(0), "id") is None


def test_checks(spark):
    df = spark.createDataFrame([(1, 5), (2, -1), (3, None)], "id int, n int")
    assert [r.id for r in warehouse.violations(df, {"n": F.col("n") >= 0}, ["id"]).orderBy("id").collect()] == [2, 3]
    docs = spark.createDataFrame([(1, ("x",)), (2, (None,))], "id int, user struct<id: string>")
    assert [r.id for r in warehouse.lacking(docs, ["user.id"]).collect()] == [2]


def test_changed_null_safe(spark):
    new = spark.createDataFrame([(1, None), (2, "b"), (3, "c")], "k int, v string")
    old = spark.createDataFrame([(1, None), (2, "a")], "k int, v string")
    assert rows(filters.changed(new, old, ["k"], ["v"])) == [(2, "b"), (3, "c")]


CITIES = [(1, "A", "UTC", 0.0, 0.0), (2, "B", "Asia/Tokyo", 0.0, 0.2), (3, "C", "UTC", 0.5, 0.0)]
CITY = "city_id int, city string, timezone string, lat_n_rad double, lng_n_rad double"


@pytest.mark.parametrize("in_row", [128, 0])
def test_nearest_place(spark, in_row):
    points = spark.createDataFrame([(1, 0.0, 0.1), (2, 0.0, 0.11), (3, None, 0.1), (4, 0.4, 0.0)], "id int, lat_rad double, lng_rad double")
    got = {r.id: r.city_id for r in places.nearest_place(points, spark.createDataFrame(CITIES, CITY), in_row=in_row).collect()}
    assert got == {1: 1, 2: 2, 3: None, 4: 3}  # halfway between two: the smaller id
    none = places.nearest_place(points, spark.createDataFrame([], CITY), in_row=in_row)
    assert {r.city_id for r in none.collect()} == {None}


def test_nearest_place_plan_has_no_shuffle_and_no_python(spark):
    points = spark.createDataFrame([(1, 0.0, 0.1)], "id int, lat_rad double, lng_rad double")
    plan = places.nearest_place(points, spark.createDataFrame(CITIES, CITY))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "EvalPython" not in plan and "hashpartitioning" not in plan


def test_stays_and_home(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    e = [(1, i, dt.datetime.combine(day(n), dt.time()), day(n), c, f"C{c}") for i, (n, c) in enumerate([(0, 1), (26, 1), (27, 2), (28, 1), (28, 1), (54, 1), (55, None)])]
    df = spark.createDataFrame(e, "user_id int, event_id int, ts timestamp, date date, city_id int, city string")
    s = places.stays(df)
    assert [r.stay_len for r in s.orderBy("stay_id").collect()] == [27, 1, 27]
    t = places.travel(s).first()
    assert (t.travel_count, list(t.travel_array), t.home_city_id) == (3, ["C1", "C2", "C1"], 1)
    assert places.travel(s, 28).first().home_city is None
    assert places.travel(places.stays(df.limit(0))).count() == 0


def test_fill_modes(spark):
    e = [(1, 1, 1, "message", 7), (1, 2, 2, "reaction", None), (1, 3, 3, "message", None), (1, 4, 4, "message", 8), (1, 5, 5, "reaction", 9), (2, 6, 1, "reaction", None)]
    df = spark.createDataFrame(e, "user_id int, event_id int, ts int, event_type string, city_id int").withColumn("city", F.col("city_id").cast("string"))
    got = lambda m: {r.event_id: (r.city_id, r.added_city) for r in places.fill_place(df, m).collect()}
    assert got("reference") == {1: (7, 0), 2: (9, 1), 3: (7, 1), 4: (8, 0), 5: (9, 0), 6: (None, 0)}
    assert got("nearest_time") == {1: (7, 0), 2: (7, 1), 3: (7, 1), 4: (8, 0), 5: (9, 0), 6: (None, 0)}


def test_radius_is_strict_and_grid_finds_all(spark):
    step = 1 / geo.EARTH_KM
    loc = spark.createDataFrame([(1, 0.9, 0.5), (2, 0.9 + 0.999 * step, 0.5), (3, 0.9 + 1.9999 * step, 0.5), (4, 1.5, -3.0)], "user_id int, lat_rad double, lng_rad double")
    ev = spark.createDataFrame([(i, "subscription", "c") for i in (1, 2, 3, 4)], "user_id int, event_type string, channel string")
    near = places.nearby_subscribers(ev, loc)
    assert rows(near.select("user_left", "user_right")) == [(1, 2)]
    none = spark.createDataFrame([], "user_left int, user_right int")
    slow = places.close_pairs(places.co_subscribers(ev), none, loc)
    assert rows(slow) == rows(near)
    assert rows(places.nearby_subscribers(ev, loc, 1.01).select("user_left", "user_right")) == [(1, 2), (2, 3)]


def test_enrichment_prices_and_unknowns(spark):
    m = {"object_id": 5, "object_type": "order", "payload": {"restaurant": {"id": "r"}, "user": {"id": "nobody"}, "final_status": "CLOSED", "order_items": [{"id": "i", "name": "I", "price": 0, "quantity": 2}, {"id": "gone", "name": "G", "price": 3, "quantity": 1}]}}
    good, _ = messages.parse(spark.createDataFrame([(json.dumps(m),)], "v string"), "v", schemas.ORDER_MESSAGE)
    rest = spark.createDataFrame([("r", "R", [("i", "I", 7.0, "soup")])], "_id string, name string, menu array<struct<_id: string, name: string, price: double, category: string>>")
    users = spark.createDataFrame([("u", "U", "l")], "_id string, name string, login string")
    p = messages.enrich_orders(good, rest, users).first().payload
    assert (p.restaurant.name, p.user.id, p.user.name) == ("R", "nobody", None)
    assert [(x.id, float(x.price), x.category) for x in p.products] == [("i", 7.0, "soup"), ("gone", 3.0, None)]


def test_enrichment_reads_messages_once(spark, tmp_path):
    """Their file is scanned once; messages without items keep their row, equal ones give one row."""
    m = lambda i, items: json.dumps({"object_id": i, "object_type": "order", "payload": {"restaurant": {"id": "r"}, "user": {"id": "u"}, "final_status": "CLOSED", "order_items": items}})
    item = {"id": "i", "name": "I", "price": 2, "quantity": 2}
    spark.createDataFrame([(x,) for x in (m(1, [item, item]), m(1, [item, item]), m(2, []), m(3, None))], "v string").write.parquet(str(tmp_path / "m"))
    good, _ = messages.parse(spark.read.parquet(str(tmp_path / "m")), "v", schemas.ORDER_MESSAGE)
    rest = spark.createDataFrame([("r", "R", [("i", "I", 7.0, "soup")])], "_id string, name string, menu array<struct<_id: string, name: string, price: double, category: string>>")
    users = spark.createDataFrame([("u", "U", "l")], "_id string, name string, login string")
    e = messages.enrich_orders(good, rest, users)
    text = io.StringIO()
    with redirect_stdout(text):
        e.explain()
    assert text.getvalue().count("FileScan parquet") == 1
    got = {r.object_id: r.payload.products for r in e.collect()}
    assert e.count() == 3 and [len(got[1]), got[2], got[3]] == [2, None, None]


def test_merge_days_computes_its_rows_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def each(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "day int, k int, v string")
    sinks.merge_days(df, str(tmp_path / "t"), ["day", "k"], "day")
    sinks.merge_days(spark.createDataFrame([(2, 1, "c"), (2, 2, "d")], df.schema).mapInPandas(each, df.schema), str(tmp_path / "t"), ["day", "k"], "day")
    assert seen.value == 2
    assert rows(spark.read.parquet(str(tmp_path / "t")).select("day", "k", "v")) == [(1, 1, "a"), (2, 1, "c"), (2, 2, "d")]
    assert [x.name for x in tmp_path.iterdir()] == ["t"]


def test_routing(spark):
    df = spark.createDataFrame([("order", "x"), ("order", None), ("other", "x"), (None, "x")], "object_type string, payload string")
    assert filters.routed(df, "order").count() == 1


def test_currency_edges(spark):
    d, e = T("2022-10-01T10:00:00"), T("2022-10-02T10:00:00")
    tx = [("a", 1, 5, "done", 10, d), ("a", 1, 5, "done", 10, d), ("b", -1, 5, "done", 10, d), ("c", 1, 5, "chargeback", 10, d), ("e", 2, None, "done", 10, d), ("f", 1, 5, "done", 20, d), ("g", 1, 5, "done", 7, e)]
    tx = spark.createDataFrame(tx, "operation_id string, account_number_from int, currency_code int, status string, amount int, transaction_dt timestamp")
    rates = spark.createDataFrame([(5, 420, T("2022-10-01"), 0.5), (5, 421, T("2022-10-01"), 9.0)], "currency_code int, currency_code_with int, date_update timestamp, currency_with_div double")
    r = marts.currency_metrics(tx, rates).collect()
    assert [(x.amount_total, x.cnt_transactions, x.avg_transactions_per_account, x.cnt_accounts_make_transactions) for x in r] == [(15.0, 2, 2.0, 1)]
    assert marts.currency_metrics(tx, rates, keep_unrated=True).count() == 2
    assert marts.currency_metrics(tx.limit(0), rates).count() == 0


def test_csv_batches_and_rejects(spark, tmp_path):
    head = "operation_id,account_number_from,account_number_to,currency_code,country,status,transaction_type,amount,transaction_dt\n"
    (tmp_path / "transactions_batch_2.csv").write_text(head + "a,1,2,420,x,done,t,5,2022-10-01 00:00:00\nb,1,2,420,x,done,t,lots,2022-10-01 00:00:00\n")
    (tmp_path / "transactions_batch_10.csv").write_text(head + "c,1,2,420,x,done,t,6,2022-10-02 00:00:00\n")
    (tmp_path / "other.csv").write_text(head + "d,1,2,420,x,done,t,6,2022-10-02 00:00:00\n")
    good, bad = files.load_csv_batches(spark, str(tmp_path), schemas.TRANSACTIONS, "transactions_batch_*.csv")
    assert [(r.operation_id, r.batch) for r in good.orderBy("batch").collect()] == [("a", 2), ("c", 10)]
    assert sinks.write_rejects(bad, str(tmp_path / "rejects")) == 1
    assert sinks.write_rejects(bad.limit(0), str(tmp_path / "none")) == 0
    later, _ = files.load_csv_batches(spark, str(tmp_path), schemas.TRANSACTIONS, "transactions_batch_*.csv", modified_after="2999-01-01T00:00:00")
    assert later.count() == 0


def test_read_cities(spark, tmp_path):
    (tmp_path / "geo.csv").write_text("id;city;lat;lng;timezone\n1;X;-33,5;151.25;Australia/Sydney\n")
    c = files.read_cities(spark, str(tmp_path / "geo.csv")).first()
    assert (c.city_id, round(c.lat_n_rad, 6), round(c.lng_n_rad, 6)) == (1, -0.584685, 2.639810)


def test_read_events_prunes_days(spark, tmp_path):
    schema = "event struct<message_from: bigint, user: string, reaction_from: string>, event_type string, date date, lat double, lon double"
    df = spark.createDataFrame([((5, None, None), "message", dt.date(2024, 1, d), 0.0, 180.0) for d in (1, 2, 3)], schema)
    df.write.partitionBy("date").parquet(str(tmp_path / "e"))
    got = files.read_events(spark, str(tmp_path / "e"), schema, dt.date(2024, 1, 2), dt.date(2024, 1, 3))
    assert [(r.user_id, round(r.lng_rad, 4)) for r in got.collect()] == [("5", 3.1416)] * 2
    assert "PartitionFilters: [isnotnull(date" in got._jdf.queryExecution().executedPlan().toString()


def test_swap_and_days(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.refresh(spark.createDataFrame([(1, "a"), (2, "b")], "k int, day string"), path, "day")
    sinks.refresh_days(spark.createDataFrame([(3, "b")], "k int, day string"), path, "day")
    assert rows(spark.read.parquet(path)) == [(1, "a"), (3, "b")]
    t = spark.read.parquet(path)
    sinks.swap(spark, t.where("k = 3"), path)
    assert rows(spark.read.parquet(path)) == [(3, "b")]


def test_options():
    o = files.jdbc_options("u", "t", column="id", low=0, high=9, partitions=3)
    assert o == {"url": "u", "dbtable": "t", "partitionColumn": "id", "lowerBound": "0", "upperBound": "9", "numPartitions": "3"}
    assert sinks.kafka_options("s:1", "x", sasl__mechanism="PLAIN")["kafka.sasl.mechanism"] == "PLAIN"


def test_as_of_nested_and_equal_starts(spark):
    day = lambda n: f"2024-01-{n:02d}"
    dim = spark.createDataFrame([(1, 1, 10, "outer"), (1, 3, 5, "inner"), (1, 3, 4, "short"), (1, 12, 12, "none"), (2, 1, 3, "b"), (2, 1, 3, "a")], "k int, f int, t int, v string")
    dim = dim.select("k", "v", F.make_date(F.lit(2024), F.lit(1), "f").cast("timestamp").alias("active_from"), F.make_date(F.lit(2024), F.lit(1), "t").cast("timestamp").alias("active_to"))
    facts = spark.createDataFrame([(1, day(n)) for n in (1, 2, 3, 4, 5, 7, 9, 10, 12)] + [(2, day(1)), (2, day(2)), (2, day(3)), (3, day(1))], "k int, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = {(r.k, r["at"].day): r.v for r in warehouse.as_of_join(facts, dim, ["k"], "at").collect()}
    assert got == {(1, 1): "outer", (1, 2): "outer", (1, 3): "inner", (1, 4): "inner", (1, 5): "outer", (1, 7): "outer", (1, 9): "outer", (1, 10): None, (1, 12): None, (2, 1): "b", (2, 2): "b", (2, 3): None, (3, 1): None}


def test_swap_recovers(spark, tmp_path):
    """A stop before, between and after the renames loses nothing."""
    path = str(tmp_path / "t")
    one, two = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(2,)], "k int")
    sinks.swap(spark, one, path)
    two.write.parquet(f"{path}.new-a")  # before the renames: the old table stays
    sinks.recover(spark, path)
    assert spark.read.parquet(path).first().k == 1
    os.rename(path, f"{path}.old-a")  # between them: the new one is whole and takes its place
    sinks.recover(spark, path)
    assert spark.read.parquet(path).first().k == 2
    os.rename(path, f"{path}.old-b")  # without a whole new one, the old one comes back
    sinks.recover(spark, path)
    assert spark.read.parquet(path).first().k == 2
    sinks.swap(spark, one, path)
    assert spark.read.parquet(path).first().k == 1 and sorted(os.listdir(tmp_path)) == ["t"]


def test_scd2_joins_sightings_only(spark):
    """Keys that differ by snapshot: rows joined grow with sightings, not with keys times snapshots."""
    keys, snaps = 2_000, 50
    at = F.expr("timestamp'2001-01-01' + make_interval(0, 0, 0, s)")
    batch = spark.range(keys).select(F.lit("r").alias("restaurant_id"), F.col("id").cast("string").alias("product_id"), F.lit(1).cast("decimal(14,2)").alias("price"), (F.col("id") % snaps).cast("int").alias("s"))
    batch = batch.withColumn("update_ts", at).drop("s")
    empty = batch.limit(0).select("restaurant_id", "product_id", "price", F.col("update_ts").alias("active_from"), F.col("update_ts").alias("active_to"))
    out = scd2(empty, batch)
    length = F.datediff("active_to", "active_from")
    assert out.count() == keys
    # the first version of a key opens early; each ends at the scope's next snapshot, the last day's stay open
    assert out.where("active_to = timestamp'2099-12-31'").count() == keys // snaps and out.where(length < 0).count() == 0
    ends = {(int(r.product_id) % snaps, r.active_to.day + 31 * (r.active_to.month - 1)) for r in out.where("active_to < timestamp'2099-12-31'").collect()}
    assert ends == {(k, k + 2) for k in range(snaps - 1)}


def test_jdbc_round_trip(spark, tmp_path):
    """Rows go to a relational table and come back in parallel parts, with a filter that is sent along."""
    o = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "table": "T", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.range(20).select(F.col("id").alias("K"), (F.col("id") * 2).alias("V"))
    sinks.append_jdbc(df.where("K < 10"), **o)
    sinks.append_jdbc(df.where("K >= 10"), **o)
    back = files.read_jdbc(spark, **o, column="K", low=0, high=20, partitions=4)
    assert back.rdd.getNumPartitions() == 4 and sorted(map(tuple, back.collect())) == [(i, 2 * i) for i in range(20)]
    assert "PushedFilters: [*IsNotNull(K), *GreaterThan(K,15)]" in back.where("K > 15")._jdf.queryExecution().toString()


def test_empty_rejects_drop_the_former_table(spark, tmp_path):
    path = str(tmp_path / "rejects")
    bad = spark.createDataFrame([("x", 1)], "_bad string, batch int")
    assert sinks.write_rejects(bad, path) == 1 and os.path.exists(path)
    assert sinks.write_rejects(bad.limit(0), path) == 0 and not os.path.exists(path)


DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def test_jdbc_batches_are_cut_in_the_source(spark, tmp_path):
    o = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "table": "T", "driver": DERBY}
    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
    sinks.append_jdbc(spark.createDataFrame([(i, f"it's {i}", day(i)) for i in range(40)] + [(None, "n", None)], "K bigint, V string, At timestamp"), **o)
    batch = files.read_jdbc_batch(spark, "K", 9, 5, **o)
    assert sorted(r.K for r in batch.collect()) == [10, 11, 12, 13, 14]
    assert "FETCH FIRST 5 ROWS ONLY" in batch._jdf.queryExecution().toString()
    assert sorted(r.K for r in files.read_jdbc_batch(spark, "At", day(36), **o).collect()) == [37, 38, 39]
    assert files._literal("it's 8") == "'it''s 8'" and files._literal(dt.date(2024, 1, 2)) == "{d '2024-01-02'}"
    assert files.read_jdbc_batch(spark, "K", 99, 5, **o).count() == 0
    parts = files.read_jdbc_parts(spark, "K", 4, **o)
    assert parts.rdd.getNumPartitions() == 4 and sorted(parts.select("K").collect(), key=repr) == sorted([(i,) for i in [*range(40), None]], key=repr)
    name = files.jdbc_catalog(spark, f"derby{os.getpid()}", o["url"], driver=DERBY)
    t = spark.table(f"{name}.APP.T").where("K > 15").agg(F.max("K").alias("m"), F.count("*").alias("n"))
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregates: [MAX(K), COUNT(*)]" in plan and "GreaterThan" in plan or "K > 15" in plan
    assert tuple(t.first()) == (39, 24)


def test_jdbc_append_once(spark, tmp_path, monkeypatch):
    o = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "table": "T", "driver": DERBY}
    df = spark.range(10).select(F.col("id").alias("K"))
    sinks.append_jdbc(df.limit(0), **o)
    assert sinks.append_jdbc_once(df, "w", 0, **o) and not sinks.append_jdbc_once(df, "w", 0, **o)
    assert sinks.append_jdbc_once(df, "other", 0, **o) and sinks.append_jdbc_once(df.limit(0), "w", 1, **o)
    assert files.read_jdbc(spark, **o).count() == 20
    # a stop within the transaction leaves the table as it was, and the batch is taken when it comes again
    wrong = df.select(F.col("K").alias("NONE"))
    with pytest.raises(Exception, match="NONE"):
        sinks.append_jdbc_once(wrong, "w", 2, **o)
    assert files.read_jdbc(spark, **o).count() == 20
    assert sinks.append_jdbc_once(df, "w", 2, **o) and files.read_jdbc(spark, **o).count() == 30
    tables = files.read_jdbc(spark, **o | {"table": "(SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLETYPE = 'T') x"})
    assert {r[0] for r in tables.collect()} == {"T", "LOADED_BATCHES"}


def test_measured_in_the_pass_that_writes(spark, tmp_path):
    df, seen = warehouse.measured(spark.range(100), n=F.count("*"), high=F.max("id"))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    df.write.parquet(str(tmp_path / "t"))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - before
    assert seen() == {"n": 100, "high": 99} and jobs <= 1
    df, broken = warehouse.checked(spark.createDataFrame([(1,), (None,), (-1,)], "x int"), {"positive": F.col("x") > 0})
    df.collect()
    assert broken() == {"positive": 2}


def test_sampled_keys_are_stable(spark):
    df = spark.createDataFrame([(i % 500, str(i)) for i in range(5000)] + [(None, "n")], "k int, v string")
    one = filters.sampled_keys(df, 0.2, "k")
    assert rows(one) == rows(filters.sampled_keys(df.repartition(7, "v").orderBy(F.desc("v")), 0.2, "k"))
    kept = {r.k for r in one.collect()}
    assert 60 < len(kept) < 140 and one.where("k IS NOT NULL").count() == 10 * len(kept - {None})
    assert filters.sampled_keys(df, 0.0, "k").count() == 0 and filters.sampled_keys(df, 1.0, "k").count() == df.count()
    assert kept != {r.k for r in filters.sampled_keys(df, 0.2, "k", seed=1).collect()}
