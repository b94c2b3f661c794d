"""The data marts, composed of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import money, times
from marlstone.operators import places as P
from marlstone.operators.filters import between, complete
from marlstone.operators.upsert import latest


def settlement(facts: DataFrame, orders: DataFrame, restaurants: DataFrame, start, end, launch_id: int = 1) -> DataFrame:
    """Restaurant and day: orders, totals, bonuses, fee and reward over CLOSED orders of an inclusive date range.

    Facts: order_id, total_sum, bonus_payment, bonus_grant. Orders: order_id, order_status, restaurant_id, date. The
    filters run before the joins; sums are combined per order first, so that orders count by rows.
    """
    closed = between(orders.where("order_status = 'CLOSED'"), "date", start, end).select("order_id", "restaurant_id", F.col("date").alias("settlement_date"))
    per_order = facts.join(closed, "order_id").groupBy("restaurant_id", "settlement_date", "order_id").agg(
        *(F.sum(c).alias(c) for c in ("total_sum", "bonus_payment", "bonus_grant"))
    )
    sums = per_order.groupBy("restaurant_id", "settlement_date").agg(
        F.count("*").alias("orders_count"),
        F.sum("total_sum").cast("decimal(14,2)").alias("orders_total_sum"),
        F.sum("bonus_payment").cast("decimal(14,2)").alias("orders_bonus_payment_sum"),
        F.sum("bonus_grant").cast("decimal(14,2)").alias("orders_bonus_granted_sum"),
    )
    total, bonus = F.col("orders_total_sum"), F.col("orders_bonus_payment_sum")
    return sums.join(restaurants.select("restaurant_id", "restaurant_name"), "restaurant_id").select(
        F.lit(launch_id).alias("launch_id"),
        "restaurant_id",
        "restaurant_name",
        "settlement_date",
        "orders_count",
        "orders_total_sum",
        "orders_bonus_payment_sum",
        "orders_bonus_granted_sum",
        money.processing_fee(total, bonus).alias("order_processing_fee"),
        money.reward(total, bonus).alias("restaurant_reward_sum"),
    )


def users_mart(events: DataFrame, cities: DataFrame, home_days: int = 27) -> DataFrame:
    """User: last city and its local time, travel chain, home city; from messages."""
    located = P.nearest_place(events.where("event_type = 'message' AND user_id IS NOT NULL"), cities)
    now = P.act_city(located)
    trips = P.travel(P.stays(located), home_days)
    return now.join(trips, "user_id", "full").select(
        "user_id", "act_city", "act_city_id", "local_time", "travel_count", "travel_array", "home_city", "home_city_id"
    )


def registrations(located: DataFrame) -> DataFrame:
    """Users by month, week and zone of their first message in a city, with the month's total."""
    m = located.where("event_type = 'message' AND city_id IS NOT NULL")
    first = m.groupBy("user_id").agg(F.min(F.struct("ts", "event_id", "date", "city_id")).alias("f"))
    by_week = first.groupBy(times.month_of(F.col("f.date")).alias("month"), times.week_of(F.col("f.date")).alias("week"), F.col("f.city_id").alias("zone_id")).agg(F.count("*").alias("week_user"))
    return by_week.withColumn("month_user", F.sum("week_user").over(Window.partitionBy("month", "zone_id")))


def event_counts(located: DataFrame) -> DataFrame:
    """Messages, reactions and subscriptions by month, week and zone (null where there are none), with month totals."""
    kinds = ("message", "reaction", "subscription")
    e = located.where("city_id IS NOT NULL")
    by_week = e.groupBy(times.month_of(F.col("date")).alias("month"), times.week_of(F.col("date")).alias("week"), F.col("city_id").alias("zone_id")).agg(
        *(F.sum(F.when(F.col("event_type") == k, 1)).alias(f"week_{k}") for k in kinds)
    )
    w = Window.partitionBy("month", "zone_id")
    return by_week.select("*", *(F.sum(f"week_{k}").over(w).alias(f"month_{k}") for k in kinds))


def zones_mart(events: DataFrame, cities: DataFrame, mode: str = "reference", ordered: bool = False) -> DataFrame:
    """Month, week and zone: counts of events and registrations."""
    filled = P.fill_place(P.nearest_place(events, cities), mode)
    cols = [f"{p}_{k}" for p in ("week", "month") for k in ("message", "reaction", "subscription", "user")]
    out = registrations(filled).join(event_counts(filled), ["month", "week", "zone_id"], "full").select("month", "week", "zone_id", *cols)
    return out.orderBy("month", "week", F.col("zone_id").cast("int")) if ordered else out


def recommendations_mart(events: DataFrame, cities: DataFrame, km: float = 1.0, now: Column | None = None) -> DataFrame:
    """Pairs of subscribers of a channel that are near each other and no contacts, with the city between them."""
    where = P.latest_place(events)
    pairs = P.nearby_subscribers(events, where, km).join(P.contacts(events), ["user_left", "user_right"], "left_anti")
    near = P.nearest_place(pairs, cities).where("city_id IS NOT NULL")
    return near.select("user_left", "user_right", (F.current_timestamp() if now is None else now).alias("processed_dttm"), "city_id", "city")


def staged(rows: DataFrame, keys: list[str], required: list[str]) -> DataFrame:
    """Complete rows, one for each key: the first by all other columns, so that every run picks the same."""
    rest = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_b")).select(*(F.col(c) if c in keys else F.col(f"_b.{c}").alias(c) for c in rows.columns))
    return complete(one, *required)


def currency_metrics(transactions: DataFrame, rates: DataFrame, start=None, end=None, base: int = 420, keep_unrated: bool = False) -> DataFrame:
    """Date and currency: turnover at the day's rate, transactions, accounts and transactions per account.

    All dates of the range come from one job. Days without a rate fall out unless ``keep_unrated``.
    """
    t = staged(transactions, ["operation_id", "transaction_dt"], ["account_number_from", "currency_code", "status", "amount"])
    t = t.where("account_number_from > 0 AND status = 'done'").withColumn("date_update", F.to_date("transaction_dt"))
    t = between(t, "date_update", start, end)
    r = staged(rates, ["currency_code", "currency_code_with", "date_update"], ["currency_with_div"]).where(F.col("currency_code_with") == base)
    r = r.select("currency_code", F.to_date("date_update").alias("date_update"), "currency_with_div")
    j = t.join(r, ["currency_code", "date_update"], "left" if keep_unrated else "inner")
    usd = money.converted(F.col("amount"), F.col("currency_with_div"))
    out = j.groupBy("date_update", F.col("currency_code").alias("currency_from")).agg(
        F.sum(usd).alias("amount_total"),
        F.count(usd).alias("cnt_transactions"),
        F.count("operation_id").alias("_n"),
        F.countDistinct("account_number_from").alias("cnt_accounts_make_transactions"),
    )
    return out.select(
        "date_update", "currency_from", "amount_total", "cnt_transactions",
        money.share_per(F.col("_n"), F.col("cnt_accounts_make_transactions")).alias("avg_transactions_per_account"),
        "cnt_accounts_make_transactions",
    )


def product_counters(events: DataFrame) -> DataFrame:
    """User and product: order rows."""
    return events.groupBy("user_id", "product_id", "product_name").agg(F.count("order_id").alias("order_cnt"))


def category_counters(events: DataFrame) -> DataFrame:
    """User and category: distinct orders."""
    return events.groupBy("user_id", "category_id", "category_name").agg(F.countDistinct("order_id").alias("order_cnt"))

