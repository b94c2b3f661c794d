"""Warehouse loads: marks, dimensions, facts, Data Vault and checks. All are functions from DataFrames to DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from marlstone.functions import times
from marlstone.functions.ids import hub_key, link_key
from marlstone.operators.segments import SEGMENT, fill, segmented
from marlstone.operators.upsert import insert_absent, latest, scd1, upsert

MARKS = "workflow_key string, mark string"


def incremental_batch(df: DataFrame, column: str, mark=None, limit: int | None = None) -> DataFrame:
    """Rows beyond the mark, in its order if capped. No mark takes all; the filter reaches the source."""
    if mark is not None:
        df = df.where(F.col(column) > F.lit(mark))
    return df if limit is None else df.orderBy(column).limit(limit)


def read_mark(state: DataFrame, key: str, default=None):
    """The stored mark of a pipeline, one small row."""
    row = state.where(F.col("workflow_key") == key).agg(F.max("mark")).first()
    return default if row is None or row[0] is None else row[0]


def write_mark(state: DataFrame, key: str, value) -> DataFrame:
    """The state with a new mark for the pipeline; written last, after the batch. An empty batch (None) leaves the mark."""
    if value is None:
        return state
    new = state.sparkSession.createDataFrame([(key, str(value))], MARKS)
    return upsert(state, new, ["workflow_key"], ["mark"])


def high_mark(batch: DataFrame, column: str):
    """The largest value of a processed batch; None if it is empty."""
    return batch.agg(F.max(column)).first()[0]


def measured(df: DataFrame, **aggregates: Column) -> tuple[DataFrame, Callable[[], dict]]:
    """``df``, and a function that gives the aggregates over it once an action has read it: marks, counts and checks of
    a load come from the pass that writes it."""
    seen = Observation()
    return df.observe(seen, *(c.alias(n) for n, c in aggregates.items())), lambda: seen.get


def checked(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, Callable[[], dict]]:
    """``df``, and how many of its rows break each check; a check that is null counts as broken."""
    return measured(df, **{n: F.count_if(~F.coalesce(c, F.lit(False))) for n, c in checks.items()})


def next_launch(state: DataFrame, report: str) -> int:
    """The number of a report's next run."""
    return int(read_mark(state, f"launch:{report}", 0)) + 1


def time_dimension(stamps: DataFrame, column: str, stored: DataFrame | None = None) -> DataFrame:
    """ts, year, month, day, time and date of each distinct timestamp that is not stored yet, with the stored ones."""
    new = stamps.select(F.col(column).alias("ts")).where("ts IS NOT NULL").distinct().select("ts", *times.parts(F.col("ts")))
    return new if stored is None else insert_absent(stored, new, ["ts"])


def resolve_orders(orders: DataFrame, restaurants: DataFrame, stamps: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, pending): orders whose parents are all stored, and the others with the names of what they lack.

    Each parent is looked up by itself, so a missing one never hides another or holds up the batch.
    """
    r = restaurants.select("restaurant_id", F.lit(True).alias("_r")).distinct()
    t = stamps.select(F.col("ts").alias("date"), F.lit(True).alias("_t")).distinct()
    u = users.select("user_id", F.lit(True).alias("_u")).distinct()
    j = orders.join(r, "restaurant_id", "left").join(t, "date", "left").join(u, "user_id", "left")
    lacks = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(n)) for c, n in (("_r", "restaurant"), ("_t", "timestamp"), ("_u", "user")))))
    j = j.select(*orders.columns, lacks.alias("missing"))
    return j.where(F.size("missing") == 0).drop("missing"), j.where(F.size("missing") > 0)


def most_versions(dim: DataFrame, key: list[str]) -> int:
    """The largest number of versions of a key."""
    return dim.groupBy(*key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def disjoint(dim: DataFrame, key: list[str], few: bool = False) -> DataFrame:
    """Versions of a key as intervals that do not overlap: at any time the newest valid version holds.

    Newest is the latest ``active_from``, then the latest ``active_to``, then the other columns. Intervals are cut at
    all starts and ends of their key, so a nested version does not end the one around it. ``version_from`` is the
    version's own start. Only the dimension is shuffled.

    The cuts of a key are numbered, and a version covers a range of numbers, which falls into some nodes of a binary tree
    (two for each level at most). The newest version of each node is found first; the newest of an interval is then that
    of the nodes above it. A key with v versions costs v log v rows, however they lie within one another. If keys are known
    to have ``few`` versions only, each interval is held against all of them instead.
    """
    rest = [c for c in dim.columns if c not in (*key, "active_from", "active_to")]
    d = dim.where("active_from < active_to")
    at = d.select(*key, F.explode(F.array("active_from", "active_to")).alias("_at")).distinct()
    w = Window.partitionBy(*key).orderBy("_at")
    told = lambda won: won.select(*key, *(F.col(f"_v.{c}").alias(c) for c in rest), F.col("_v.active_from").alias("version_from"), F.col("_at").alias("active_from"), F.col("_to").alias("active_to"))
    if few:
        p = at.withColumn("_to", F.lead("_at").over(w)).where("_to IS NOT NULL").alias("p")
        cond = [F.col(f"p.{k}") == F.col(f"d.{k}") for k in key] + [F.col("d.active_from") <= F.col("_at"), F.col("_at") < F.col("d.active_to")]
        j = p.join(d.alias("d"), cond).select(*(F.col(f"p.{k}") for k in key), "_at", "_to", F.struct("d.active_from", "d.active_to", *(F.col(f"d.{c}") for c in rest)).alias("_v"))
        return told(j.groupBy(*key, "_at", "_to").agg(F.max("_v").alias("_v")))
    at = at.select(*key, "_at", F.lead("_at").over(w).alias("_to"), (F.row_number().over(w) - 1).alias("_n"))
    cut = lambda name, column: at.select(*key, F.col("_at").alias(column), F.col("_n").alias(name))
    version = F.struct("active_from", "active_to", *rest)
    spans = d.select(*key, "active_from", "active_to", version.alias("_v")).join(cut("_l", "active_from"), [*key, "active_from"]).join(cut("_r", "active_to"), [*key, "active_to"])

    def nodes(h: Column) -> Column:
        # the range [l, r) of numbers, in nodes of 2^h numbers each; an odd end stands alone on its level
        l, r = F.floor((F.col("_l") + F.pow(F.lit(2), h) - 1) / F.pow(F.lit(2), h)), F.floor(F.col("_r") / F.pow(F.lit(2), h))
        left = F.when((l < r) & (l % 2 == 1), l)
        right = F.when((l < r) & (r % 2 == 1) & (l + l % 2 < r), r - 1)
        return F.transform(F.array_compact(F.array(left, right)), lambda x: F.struct(h.alias("h"), x.cast("int").alias("x")))

    levels = lambda n: F.sequence(F.lit(0), F.floor(F.log2(n + 1)).cast("int"))
    tree = spans.select(*key, "_v", F.explode(F.flatten(F.transform(levels(F.col("_r")), nodes))).alias("_t"))
    tree = tree.groupBy(*key, F.col("_t.h").alias("_h"), F.col("_t.x").alias("_x")).agg(F.max("_v").alias("_v"))
    # nodes above an interval: as many levels as the key's cuts need
    top = F.max("_n").over(Window.partitionBy(*key))
    own = at.withColumn("_top", top).where("_to IS NOT NULL").select(*key, "_at", "_to", "_n", F.explode(levels(F.col("_top"))).alias("_h"))
    own = own.withColumn("_x", F.floor(F.col("_n") / F.pow(F.lit(2), F.col("_h"))).cast("int"))
    won = own.join(tree, [*key, "_h", "_x"]).groupBy(*key, "_at", "_to").agg(F.max("_v").alias("_v"))
    return told(won)


#: Versions of a key up to which a fact is held against all of them.
FEW_VERSIONS = 64


def as_of_join(facts: DataFrame, dim: DataFrame, key: list[str], ts: str, how: str = "left", few: int = FEW_VERSIONS, chunk: str = "day") -> DataFrame:
    """The newest version of each fact's key that is valid at its time: [active_from, active_to). ``how``: left or inner.

    Versions are made disjoint first, so a fact meets one at most. If no key has more than ``few`` versions, this is an
    equi-join on the key with the interval as a further condition, which Spark may broadcast. Otherwise facts and the
    starts of intervals are put in one order by time, and each fact takes the last start before it: within a ``chunk``
    of the key's time, and from chunk to chunk by one row each, so neither a long history nor a hot key fills a task.
    """
    rest = [c for c in dim.columns if c not in (*key, "active_from", "active_to")]
    small = most_versions(dim, key) <= few
    d = disjoint(dim, key, small)
    if small:
        d, f = d.alias("d"), facts.alias("f")
        cond = [F.col(f"f.{k}") == F.col(f"d.{k}") for k in key] + [F.col("d.active_from") <= F.col(f"f.{ts}"), F.col(f"f.{ts}") < F.col("d.active_to")]
        return f.join(d, cond, how).select("f.*", *(F.col(f"d.{c}") for c in rest), F.col("d.version_from").alias("version_from"))
    at = lambda c: F.col(c).cast("timestamp").alias("_ts")
    version = F.struct("active_to", "version_from", *rest)
    starts = d.select(*key, at("active_from"), F.lit(0).alias("_kind"), version.alias("_v"))
    rows = facts.select(*key, at(ts), F.lit(1).alias("_kind"), F.struct(*(F.col(f"`{c}`") for c in facts.columns)).alias("_f"))
    both = segmented(rows.unionByName(starts, allowMissingColumns=True), key, at=F.date_trunc(chunk, "_ts"))
    met, last, _ = fill(both, key, ["_ts", "_kind"], F.col("_v"), [F.col(f"{SEGMENT}.at").asc()])
    met = met.where("_kind = 1").withColumn("_w", F.when(F.col(f"{last}.active_to") > F.col("_ts"), F.col(last)))
    met = met.where("_w IS NOT NULL") if how == "inner" else met
    return met.select("_f.*", *(F.col(f"_w.{c}").alias(c) for c in rest), F.col("_w.version_from").alias("version_from"))


def known_products(bonuses: DataFrame, products: DataFrame) -> DataFrame:
    """Bonus rows of products that the dimension has."""
    return bonuses.join(products.select("product_id").distinct(), "product_id", "left_semi").select(*bonuses.columns)


def audited(df: DataFrame, load_src: str, load_dt: Column | None = None) -> DataFrame:
    """Rows with the time and source of their load."""
    return df.select("*", (F.current_timestamp() if load_dt is None else load_dt).alias("load_dt"), F.lit(load_src).alias("load_src"))


def order_dimension(stored: DataFrame, orders: DataFrame) -> DataFrame:
    """New orders are added; of stored ones only the status follows."""
    return scd1(stored, orders, ["order_id"], ["order_status"], ["update_ts"])


def sales_fact(items: DataFrame, products: DataFrame, bonuses: DataFrame, ts: str = "date") -> DataFrame:
    """CLOSED order items with their product version and bonuses (0 without), one row for each order and product."""
    closed = items.where("final_status = 'CLOSED'")
    known = as_of_join(closed, products, ["product_id"], ts, "inner")
    paid = bonuses.groupBy("order_id", "product_id").agg(F.sum("bonus_payment").alias("bonus_payment"), F.sum("bonus_grant").alias("bonus_grant"))
    j = known.join(paid, ["order_id", "product_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(14,2)").alias(c)
    j = j.select("order_id", "product_id", "version_from", "count", "price", "total_sum", zero("bonus_payment"), zero("bonus_grant"))
    return latest(j, ["order_id", "product_id"], ["version_from"])


def menu_diff(current: DataFrame, menu: DataFrame, key: list[str]) -> DataFrame:
    """Each key with what has become of it: new, kept or gone."""
    a, b = current.select(*key).distinct().withColumn("_a", F.lit(1)), menu.select(*key).distinct().withColumn("_b", F.lit(1))
    j = a.join(b, key, "full")
    return j.select(*key, F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").otherwise("kept").alias("change"))


def hub(df: DataFrame, business_key: str, load_src: str = "orders", load_dt: Column | None = None) -> DataFrame:
    """A hub's rows: key, business id, load time and source; one for each id."""
    rows = df.select(F.col(business_key).cast("string").alias("business_id")).where("business_id IS NOT NULL").distinct()
    return audited(rows.select(hub_key(F.col("business_id")).alias("pk"), "business_id"), load_src, load_dt)


def satellite(df: DataFrame, business_key: str, attributes: list[str], order_by: list[str], load_src: str = "orders", load_dt: Column | None = None) -> DataFrame:
    """The latest attributes of each hub row, with load time and source."""
    key = F.col(business_key).cast("string")
    rows = df.where(F.col(business_key).isNotNull()).select(key.alias("_id"), *attributes, *(c for c in order_by if c not in attributes))
    # ids are shorter than the keys that they make, and tell rows apart as well
    return audited(latest(rows, ["_id"], order_by).select(hub_key(F.col("_id")).alias("pk"), *attributes), load_src, load_dt)


def link(df: DataFrame, left: str, right: str, load_src: str = "orders", load_dt: Column | None = None) -> DataFrame:
    """A link's rows: its key and the two hub keys, with load time and source."""
    ids = df.select(F.col(left).cast("string").alias("_left"), F.col(right).cast("string").alias("_right")).where("_left IS NOT NULL AND _right IS NOT NULL").distinct()
    pairs = ids.select(hub_key(F.col("_left")).alias("left_pk"), hub_key(F.col("_right")).alias("right_pk"))
    return audited(pairs.select(link_key(F.col("left_pk"), F.col("right_pk")).alias("pk"), "left_pk", "right_pk"), load_src, load_dt)


def last_in_order(items: DataFrame, order: str, key: str, position: str) -> DataFrame:
    """Repeated products (or categories) of one order: the last one by position stays."""
    return latest(items, [order, key], [position])


def violations(df: DataFrame, checks: dict[str, Column], keys: list[str]) -> DataFrame:
    """(keys, failed) of rows that break a check; a check that is null counts as broken. One pass for all checks."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())))
    return df.select(*keys, failed.alias("failed")).where(F.size("failed") > 0)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Business keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Child rows without a parent; rows with a null key are not asked."""
    some = child.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))
    return some.join(parent.select(*keys).distinct(), keys, "left_anti")


def lacking(df: DataFrame, fields: list[str]) -> DataFrame:
    """Parsed documents in which a required field (nested by dots) is null, with the names of those fields."""
    lost = F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in fields)))
    return df.withColumn("lacking", lost).where(F.size("lacking") > 0)
