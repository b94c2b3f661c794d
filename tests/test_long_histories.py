"""Hot users, hot channels, long version histories and large dictionaries beside brute force."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import geo
from marlstone.operators import places, upsert, warehouse
from marlstone.operators.segments import SEGMENT, segmented

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def history():
    """Events of 40 users; the first has a third of all, over many hours, with gaps, ties and nulls."""
    rnd = random.Random(7)
    out = []
    for i in range(3000):
        user = 1 if i % 3 == 0 else rnd.choice([*range(2, 40), None])
        at = T0 + dt.timedelta(minutes=rnd.randint(0, 4000) * 5)
        city = rnd.choice([None, None, 1, 2, 3, 3])
        out.append((user, i, rnd.choice(["message", "reaction", "subscription"]), at, at.date(), city, city and f"C{city}"))
    return out


@pytest.fixture(scope="module")
def events(spark, history):
    return spark.createDataFrame(history, "user_id int, event_id int, event_type string, ts timestamp, date date, city_id int, city string")


def brute_fill(history, mode):
    out = {}
    for user in {h[0] for h in history}:
        own = [h for h in history if h[0] == user]
        for h in own:
            if mode == "reference":
                back = sorted(own, key=lambda x: (x[2] == "message", x[3], x[1]))
                fore = sorted(own, key=lambda x: (x[2] != "message", x[3], x[1]))
                known = lambda x: x[5]
            else:
                back = fore = sorted(own, key=lambda x: (x[3], x[1]))
                known = lambda x: x[5] if x[2] == "message" else None
            before = [known(x) for x in back[: back.index(h) + 1] if known(x)]
            after = [known(x) for x in fore[fore.index(h) :] if known(x)]
            found = before[-1] if before else after[0] if after else None
            out[h[1]] = (h[5] or found, int(h[5] is None and found is not None))
    return out


@pytest.mark.parametrize("mode", ["reference", "nearest_time"])
@pytest.mark.parametrize("chunk, most", [("hour", 0), ("year", 0), ("hour", 10**6)])
def test_fill_beside_brute_force(events, history, mode, chunk, most):
    got = {r.event_id: (r.city_id, r.added_city) for r in places.fill_place(events, mode, chunk, most).collect()}
    assert got == brute_fill(history, mode)


@pytest.mark.parametrize("chunk, most", [("hour", 0), ("week", 0), ("year", 0), ("hour", 10**6)])
def test_stays_beside_brute_force(events, history, chunk, most):
    want = []
    for user in {h[0] for h in history}:
        own = sorted((h for h in history if h[0] == user and h[5]), key=lambda x: (x[3], x[1]))
        for n, (city, run) in enumerate(itertools.groupby(own, key=lambda x: x[5]), 1):
            run = list(run)
            want.append((user, n, city, f"C{city}", run[0][4], run[-1][4], run[0][3], (run[-1][4] - run[0][4]).days + 1))
    got = places.stays(events, chunk, most).select("user_id", "stay_id", "city_id", "city", "stay_start", "stay_end", "stay_start_ts", "stay_len")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_a_hot_user_is_spread(events, history):
    """A third of all events are of one user, and no segment holds more than a few of them."""
    sizes = segmented(events, ["user_id"], at=F.date_trunc("hour", "ts")).groupBy(SEGMENT).count()
    assert sizes.agg(F.max("count")).first()[0] < 20 < len([h for h in history if h[0] == 1]) / 40
    plan = places.fill_place(events, most=500)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_segment" in plan and "Python" not in plan


def _sphere(rng, n):
    lat, lng = np.arcsin(rng.uniform(-1, 1, n)), rng.uniform(-np.pi, np.pi, n)
    return lat, lng


def test_nearest_by_cubes_beside_brute_force(spark):
    rng = np.random.default_rng(5)
    lat, lng = _sphere(rng, 20_000)
    lat[:4000], lng[:4000] = rng.normal(0.8, 0.01, 4000), rng.normal(0.3, 0.01, 4000)  # a dense coast
    lat[4000:4006], lng[4000:4006] = [np.pi / 2, -np.pi / 2, 0, 0, 1.0, 1.0], [0, 1, np.pi, -np.pi, 2.0, 2.0]
    p_lat, p_lng = _sphere(rng, 1500)
    p_lat[:300], p_lng[:300] = rng.normal(0.8, 0.012, 300), rng.normal(0.3, 0.012, 300)
    p_lat[300:308], p_lng[300:308] = [np.pi / 2, -np.pi / 2, 1.5707, -1.5707, 0, 0, 0.0001, 1.0], [3, 2, 1, -1, np.pi, -np.pi, -3.14159, 2.0]
    dictionary = spark.createDataFrame([(i, f"c{i}", "UTC", float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lng, strict=True))], "city_id int, city string, timezone string, lat_n_rad double, lng_n_rad double")
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(p_lat, p_lng, strict=True))] + [(9999, None, 1.0)], "id int, lat_rad double, lng_rad double")
    got = {r.id: r.city_id for r in places.nearest_place(points, dictionary).collect()}
    assert got.pop(9999) is None and len(got) == 1500
    d = lambda i: 2 * np.arcsin(np.sqrt(np.minimum(1, np.sin((p_lat[i] - lat) / 2) ** 2 + np.cos(p_lat[i]) * np.cos(lat) * np.sin((p_lng[i] - lng) / 2) ** 2)))
    for i in range(1500):
        own = d(i)
        assert own[got[i]] <= own.min() + 1e-12, i
    assert got[307] == 4004  # of two places at one point the smaller id
    # how many places a point is held against
    level = 9
    located = points.where("lat_rad IS NOT NULL").withColumns(places._on_sphere("lat_rad", "lng_rad")).withColumns(places._cube(level))
    lists = places.nearest_candidates(located.select("_i", "_j", "_k").distinct(), dictionary, level)
    compared = located.join(lists, ["_i", "_j", "_k"]).agg(F.sum(F.size("_places"))).first()[0]
    assert compared < 0.01 * 1500 * 20_000


def test_hot_channel_is_tiled(spark):
    rnd = random.Random(1)
    rows = [(u, "hot") for u in range(300)] + [(rnd.randint(0, 900), rnd.choice("abcdefgh")) for _ in range(600)] + [(1, None), (None, "a"), (5, "hot")]
    ev = spark.createDataFrame([(u, "subscription", c) for u, c in rows], "user_id int, event_type string, channel string")
    held = {}
    for u, c in rows:
        if u is not None and c is not None:
            held.setdefault(c, set()).add(u)
    want = {p for us in held.values() for p in itertools.combinations(sorted(us), 2)}
    for block in (2000, 25):
        got = [tuple(r) for r in places.co_subscribers(ev, block).collect()]
        assert len(got) == len(want) and set(got) == want
    step = 1 / geo.EARTH_KM
    where = {u: (0.9 + rnd.uniform(-1, 1) * step, 0.5 + rnd.uniform(-2, 2) * step) for u in range(901)}
    loc = spark.createDataFrame([(u, *x) for u, x in where.items()], "user_id int, lat_rad double, lng_rad double")
    slow = places.close_pairs(places.co_subscribers(ev), spark.createDataFrame([], "user_left int, user_right int"), loc)
    near = [sorted(map(tuple, places.nearby_subscribers(ev, loc, block=b).collect())) for b in (2000, 20)]
    assert near[0] == near[1] == sorted(map(tuple, slow.collect())) and len(near[0]) > 1000


def newest(versions, t):
    valid = [v for v in versions if v[0] <= t < v[1]]
    return max(valid) if valid else None


@pytest.mark.parametrize("few", [10**9, 0])
def test_as_of_beside_brute_force(spark, few):
    rnd = random.Random(3)
    day = lambda n: T0 + dt.timedelta(hours=n)
    dim, facts = [], []
    for k in range(6):
        for v in range(60 if k else 2):
            a = rnd.randint(0, 400)
            dim.append((k, day(a), day(a + rnd.choice([0, 1, 5, 50, 400])), f"v{v}"))
    dim += [dim[5], (None, day(0), day(900), "n")]
    facts = [(i, rnd.choice([0, 1, 2, 3, 4, 5, 9, None]), day(rnd.randint(-5, 850)) if i % 50 else None) for i in range(800)]
    d = spark.createDataFrame(dim, "k int, active_from timestamp, active_to timestamp, v string")
    f = spark.createDataFrame(facts, "id int, k int, at timestamp")
    want = {}
    for i, k, t in facts:
        best = newest([(a, b, v) for kk, a, b, v in dim if kk == k and k is not None], t) if t else None
        want[i] = (best[2], best[0]) if best else (None, None)
    got = {r.id: (r.v, r.version_from) for r in warehouse.as_of_join(f, d, ["k"], "at", few=few).collect()}
    assert got == want
    inner = warehouse.as_of_join(f, d, ["k"], "at", "inner", few=few)
    assert inner.columns == ["id", "k", "at", "v", "version_from"] and {r.id for r in inner.collect()} == {i for i, x in want.items() if x[0]}


def test_as_of_one_key_with_many_versions(spark):
    """20,000 versions of one key, half of them within others: rows grow with v log v, not with its square."""
    n = 20_000
    dim = spark.range(n).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 100).alias("active_from"), F.timestamp_seconds(F.col("id") * 100 + F.when(F.col("id") % 2 == 0, 1_000_000).otherwise(50)).alias("active_to"), F.col("id").alias("v"))
    cuts = warehouse.disjoint(dim, ["k"])
    facts = spark.range(0, n * 100, 37).select(F.lit(1).alias("k"), F.timestamp_seconds("id").alias("at"), F.col("id").alias("s"))
    got = warehouse.as_of_join(facts, dim, ["k"], "at")
    s = F.col("s")
    # an odd version holds for half of its 100 seconds, then the even one before it
    want = F.when((F.floor(s / 100) % 2 == 1) & (s % 100 >= 50), F.floor(s / 100) - 1).otherwise(F.floor(s / 100))
    assert got.where(~F.col("v").eqNullSafe(want)).count() == 0 and got.count() == facts.count()
    assert cuts.count() < 3 * n


def brute_scd2(snapshots):
    """Versions (scope, key, value, from, to) of whole snapshots (scope, key, value, time)."""
    times = {}
    for s, _, _, t in snapshots:
        times.setdefault(s, set()).add(t)
    at = {(s, k, t): v for s, k, v, t in snapshots}
    out = []
    for s, k in {(x[0], x[1]) for x in snapshots}:
        now, first = None, True
        for t in sorted(times[s]):
            v = at.get((s, k, t))
            if now and now[0] != v:
                out.append((s, k, now[0], now[1], t))
                now = None
            if v is not None and now is None:
                now = (v, dt.datetime(1999, 1, 1) if first else t)
                first = False
        if now:
            out.append((s, k, now[0], now[1], dt.datetime(2099, 12, 31)))
    return sorted(out)


def test_scd2_of_many_keys_and_snapshots(spark):
    rnd = random.Random(9)
    rows = [(s, k, rnd.choice([1, 1, 2]), T0 + dt.timedelta(days=t)) for s in (1, 2) for k in range(40) for t in range(0, 60, s) if rnd.random() < 0.8]
    snaps = spark.createDataFrame(rows, "restaurant_id int, product_id int, price int, update_ts timestamp")
    empty = snaps.limit(0).select("restaurant_id", "product_id", "price", F.col("update_ts").alias("active_from"), F.col("update_ts").alias("active_to"))
    step = lambda cur, b: upsert.scd2(cur, b, "restaurant_id", ["product_id"], ["price"], "update_ts")
    want = brute_scd2(rows)
    whole = step(empty, snaps)
    assert sorted(map(tuple, whole.collect())) == want
    cut = F.lit(T0 + dt.timedelta(days=30))
    parts = step(step(empty, snaps.where(F.col("update_ts") < cut)), snaps.where(F.col("update_ts") >= cut))
    assert sorted(map(tuple, parts.collect())) == want
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan  # no array of a scope's times travels with its keys
