"""Nearest places, visits and travel: the operators of the event marts."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.geo import cells, distance_km
from marlstone.functions.times import local_time
from marlstone.operators.segments import SEGMENT, fill, once, runs, segmented
from marlstone.operators.upsert import latest

#: Events of a user up to which one task holds them all; beyond, the stretch of a user's time that it holds.
WHOLE_USER, CHUNK = 1_000_000, "hour"
#: Users of a channel, or of a cube of one, that meet in one task, about.
BLOCK = 2_000
#: Blocks into which a channel's users are cut, unless blocks had more than so many users then. A user is sent to a tile
#: for each of them, so what is shuffled grows with the users and not with their square.
GRID, LARGEST_BLOCK = 8, 250_000
#: Words of bits by which users know their largest channels, and bits of a word (so that no sum of them overflows).
WORDS, BITS = 4, 62
#: Large groups of which the number of blocks is broadcast.
BROADCAST_GROUPS = 100_000

#: Dictionaries of up to so many places are held against every point in its row; larger ones get an index.
IN_ROW = 128
#: Distances of chords on the unit sphere that count as equal while candidates are chosen.
SLACK = 1e-7
#: The first level of cubes: 4 along each axis; and the levels beyond cubes of one place on average, for dense regions.
TOP, FINER = 2, 2


def _on_sphere(lat: str, lng: str) -> dict[str, Column]:
    """Coordinates on the unit sphere."""
    lat_c, lng_c = F.col(lat), F.col(lng)
    return {"_x": F.cos(lat_c) * F.cos(lng_c), "_y": F.cos(lat_c) * F.sin(lng_c), "_z": F.sin(lat_c)}


def _cube(level: int) -> dict[str, Column]:
    """The cube of a level that holds a point: the one around the sphere is halved so many times."""
    n = 1 << level
    at = lambda c: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(c) + 1) * (n / 2)))).cast("int")
    return {"_i": at("_x"), "_j": at("_y"), "_k": at("_z")}


def nearest_candidates(cubes: DataFrame, places: DataFrame, level: int) -> DataFrame:
    """(_i, _j, _k, _places): for each of the given cubes of ``level`` all places that are nearest to a point in it.

    From large cubes to small ones, a cube keeps the places whose least distance to it is within the least of all
    greatest distances; its parts look at those only. Of places at one point the smallest id stays. A place has a row for
    each cube that keeps it, so nothing is gathered before the lists are short.
    """
    one = places.groupBy("lat_n_rad", "lng_n_rad").agg(F.min(F.struct(F.col("city_id").cast("int").alias("city_id"), "city", "timezone")).alias("c"))
    one = one.select("lat_n_rad", "lng_n_rad", "c.*").where("lat_n_rad IS NOT NULL AND lng_n_rad IS NOT NULL")
    one = one.select(*(c.alias(n) for n, c in _on_sphere("lat_n_rad", "lng_n_rad").items()), F.struct("lat_n_rad", "lng_n_rad", "city_id", "city", "timezone").alias("_place"))
    part = lambda l: cubes.select(*(F.shiftright(c, level - l).alias(c) for c in ("_i", "_j", "_k"))).distinct()
    some = F.explode(F.sequence(F.lit(0), F.lit((1 << TOP) - 1)))
    pairs = one.withColumn("_i", some).withColumn("_j", some).withColumn("_k", some).join(part(TOP), ["_i", "_j", "_k"], "left_semi")
    for l in range(TOP, level + 1):
        if l > TOP:
            child = part(l).select(*(F.shiftright(c, 1).alias(c) for c in ("_i", "_j", "_k")), *(F.col(c).alias(f"{c}c") for c in ("_i", "_j", "_k")))
            pairs = pairs.join(child, ["_i", "_j", "_k"]).select("_x", "_y", "_z", "_place", *(F.col(f"{c}c").alias(c) for c in ("_i", "_j", "_k")))
        half = 1 / (1 << l)
        off = [F.abs(F.col(a) - ((F.col(b) * 2 + 1) * half - 1)) for a, b in (("_x", "_i"), ("_y", "_j"), ("_z", "_k"))]
        near = reduce(lambda a, b: a + b, (F.pow(F.greatest(F.lit(0.0), d - half), F.lit(2)) for d in off))
        far = reduce(lambda a, b: a + b, (F.pow(d + half, F.lit(2)) for d in off))
        pairs = pairs.withColumn("_far", F.min(F.sqrt(far)).over(Window.partitionBy("_i", "_j", "_k"))).where(F.sqrt(near) <= F.col("_far") + SLACK).drop("_far")
    return pairs.groupBy("_i", "_j", "_k").agg(F.collect_list("_place").alias("_places"))


def nearest_place(points: DataFrame, places: DataFrame, lat: str = "lat_rad", lng: str = "lng_rad", in_row: int = IN_ROW) -> DataFrame:
    """``points`` with city_id, city and timezone of the nearest place; null coordinates get null, ties the smaller id.

    A dictionary (city_id, city, timezone, lat_n_rad, lng_n_rad) of up to ``in_row`` places goes to every task as one
    row, and the minimum is taken in the row: points are neither multiplied nor shuffled. For a larger one the sphere is
    cut into cubes, of a sixteenth of a place each on average; a cube's points look at the places that can be nearest in it, and no others.
    """
    n = places.count()
    rest = [c for c in points.columns if c not in ("city_id", "city", "timezone", "_places", "_x", "_y", "_z", "_i", "_j", "_k")]
    if n <= in_row:
        one = places.agg(F.collect_list(F.struct("lat_n_rad", "lng_n_rad", F.col("city_id").cast("int").alias("city_id"), "city", "timezone")).alias("_places"))
        out = points.select(*rest).crossJoin(F.broadcast(one))
    else:
        level = max(TOP, math.ceil(math.log2(math.sqrt(n / math.pi))) + FINER)
        located = points.select(*rest).withColumns(_on_sphere(lat, lng)).withColumns(_cube(level))
        cubes = located.where("_i IS NOT NULL AND _j IS NOT NULL AND _k IS NOT NULL").select("_i", "_j", "_k").distinct()
        out = located.join(nearest_candidates(cubes, places, level), ["_i", "_j", "_k"], "left").select(*rest, "_places")
    found = F.array_min(
        F.transform(
            "_places",
            lambda c: F.struct(distance_km(F.col(lat), F.col(lng), c["lat_n_rad"], c["lng_n_rad"]).alias("d"), c["city_id"].alias("city_id"), c["city"].alias("city"), c["timezone"].alias("timezone")),
        )
    )
    found = F.when(F.col(lat).isNotNull() & F.col(lng).isNotNull(), found)
    out = out.select(*rest, found.alias("_best"))
    return out.select(*rest, F.col("_best.city_id").alias("city_id"), F.col("_best.city").alias("city"), F.col("_best.timezone").alias("timezone"))


def latest_place(events: DataFrame, user: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last located event of each user."""
    return latest(events.where(F.col("lat_rad").isNotNull() & F.col("lng_rad").isNotNull()), [user], [ts, tie])


def _hot(events: DataFrame, most: int) -> bool:
    """Whether some user has more than ``most`` events."""
    return (events.groupBy("user_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > most


def fill_place(events: DataFrame, mode: str = "reference", chunk: str = CHUNK, most: int = WHOLE_USER) -> DataFrame:
    """Cities of events without one, from other events of the user.

    ``reference``: messages among messages and other events among others, the last city before, else the next behind,
    as their frames have it. ``nearest_time``: the city of the last message before, else of the next message.
    Columns user_id, event_type, ts, event_id, city_id, city; added_city tells filled rows. If a user has more than
    ``most`` events, a task holds a user's events of one ``chunk`` of time (a unit of date_trunc), not all of them.
    """
    if mode not in ("reference", "nearest_time"):
        raise ValueError(mode)
    messages = mode == "nearest_time"
    is_message = F.when(F.col("event_type") == "message", 1).otherwise(0)
    place = F.when(F.col("city_id").isNotNull(), F.struct("city_id", "city"))
    at, kind = F.date_trunc(chunk, F.col("ts").cast("timestamp")), F.col(f"{SEGMENT}.kind")
    time = F.col(f"{SEGMENT}.at")
    rest = [c for c in events.columns if c not in ("city_id", "city", "added_city")]
    known = F.when(F.col("event_type") == "message", place) if messages else place
    first = [] if messages else [is_message.asc()]
    if not _hot(events, most):
        w, upto = Window.partitionBy("user_id"), (Window.unboundedPreceding, 0)
        before = F.last(known, True).over(w.orderBy(*first, "ts", "event_id").rowsBetween(*upto))
        after = F.last(known, True).over(w.orderBy(*first, F.desc("ts"), F.desc("event_id")).rowsBetween(*upto))
        filled, back, fore = events.withColumns({"_back": before, "_fore": after}), "_back", "_fore"
    elif messages:
        cut = segmented(once(events), ["user_id"], at=at)
        filled, back, fore = fill(cut, ["user_id"], ["ts", "event_id"], known, [time.asc()], [time.desc()])
    else:
        cut = segmented(once(events), ["user_id"], kind=is_message, at=at)
        filled, back, fore = fill(cut, ["user_id"], ["ts", "event_id"], known, [kind.asc(), time.asc()], [kind.asc(), time.desc()])
    found = F.coalesce(F.col(back), F.col(fore))
    return filled.select(
        *rest,
        F.coalesce("city_id", found["city_id"]).alias("city_id"),
        F.coalesce("city", found["city"]).alias("city"),
        F.when(F.col("city_id").isNull() & found.isNotNull(), 1).otherwise(0).alias("added_city"),
    )


def stays(events: DataFrame, chunk: str = CHUNK, most: int = WHOLE_USER) -> DataFrame:
    """One row for each run of events of a user in one city: bounds, length in days and first time.

    Columns user_id, ts, event_id, date, city_id, city. If a user has more than ``most`` events, runs are found within a
    ``chunk`` of a user's time and put together over the chunks' edges, so no user fills a task.
    """
    rows = events.where("city_id IS NOT NULL").select("user_id", "ts", "event_id", "date", "city_id", "city")
    bounds = (F.min("city").alias("city"), F.min("date").alias("stay_start"), F.max("date").alias("stay_end"), F.min("ts").alias("stay_start_ts"))
    if not _hot(events, most):
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        flagged = rows.withColumn("_new", F.when(F.col("city_id") == F.lag("city_id").over(w), 0).otherwise(1))
        numbered = flagged.withColumn("stay_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return numbered.groupBy("user_id", "stay_id").agg(F.min("city_id").alias("city_id"), *bounds).withColumn("stay_len", F.datediff("stay_end", "stay_start") + 1)
    rows = segmented(rows, ["user_id"], at=F.date_trunc(chunk, F.col("ts").cast("timestamp")))
    local = runs(rows, ["user_id"], ["ts", "event_id"], "city_id", [F.col(f"{SEGMENT}.at")], *bounds)
    out = local.groupBy("user_id", F.col("run_id").alias("stay_id")).agg(
        F.min("city_id").alias("city_id"), F.min("city").alias("city"), F.min("stay_start").alias("stay_start"), F.max("stay_end").alias("stay_end"), F.min("stay_start_ts").alias("stay_start_ts")
    )
    return out.withColumn("stay_len", F.datediff("stay_end", "stay_start") + 1)


def travel(stay_rows: DataFrame, home_days: int = 27) -> DataFrame:
    """For each user the number and order of stays, and the city of the last stay of ``home_days`` or more."""
    home = F.max(F.when(F.col("stay_len") >= home_days, F.struct("stay_start_ts", "stay_id", "city_id", "city"))).alias("_home")
    chain = F.sort_array(F.collect_list(F.struct("stay_start_ts", "stay_id", "city")))
    out = stay_rows.groupBy("user_id").agg(F.count("*").alias("travel_count"), chain.alias("_chain"), home)
    return out.select("user_id", "travel_count", F.col("_chain.city").alias("travel_array"), F.col("_home.city").alias("home_city"), F.col("_home.city_id").alias("home_city_id"))


def act_city(located: DataFrame) -> DataFrame:
    """City and local time of each user's last event in a city."""
    last = latest(located.where("city_id IS NOT NULL").select("user_id", "ts", "event_id", "city_id", "city", "timezone"), ["user_id"], ["ts", "event_id"])
    return last.select("user_id", F.col("city").alias("act_city"), F.col("city_id").alias("act_city_id"), local_time(F.col("ts"), F.col("timezone")).alias("local_time"))


def contacts(events: DataFrame) -> DataFrame:
    """Pairs of users that have written to each other, the smaller id first."""
    m = events.where("event_type = 'message' AND user_id IS NOT NULL AND message_to IS NOT NULL")
    return m.select(F.least("user_id", "message_to").alias("user_left"), F.greatest("user_id", "message_to").alias("user_right")).distinct()


def _subscriptions(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'subscription' AND channel IS NOT NULL AND user_id IS NOT NULL").select("user_id", "channel").distinct()


def _blocks(rows: DataFrame, group: list[str], block: int) -> DataFrame | None:
    """(group, _b) of groups of more than ``block`` rows: how many blocks they are cut into; None if there are none.

    There are rows / block of them at most; they are broadcast only if their counted number is within bounds.
    """
    large = rows.groupBy(*group).agg(F.ceil(F.count("*") / block).cast("int").alias("_b")).where("_b > 1")
    n = large.count()
    return None if not n else F.broadcast(large) if n <= BROADCAST_GROUPS else large


def _cuts(n: Column, block: int) -> Column:
    """Into how many blocks so many users of a channel are cut: of ``block`` users, or ``GRID`` larger ones."""
    blocks = lambda most: F.ceil(n / most)
    return F.greatest(F.least(blocks(block), F.lit(GRID)), blocks(max(block, LARGEST_BLOCK))).cast("int")


def _words(users: DataFrame) -> DataFrame:
    """(user_id, _w): for each user the bits of its large channels, ``BITS`` to a word."""
    word = lambda i: F.coalesce(F.bit_or(F.when(F.floor(F.col("_r") / BITS) == i, F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("_r") % BITS).cast("int")))), F.lit(0))
    return users.groupBy("user_id").agg(*(word(i).cast("bigint").alias(f"_w{i}") for i in range(WORDS)))


def _first_bit(left: str, right: str) -> Column:
    """The rank of the first large channel that both users have; null if there is none."""
    both = [F.col(f"{left}{i}").bitwiseAND(F.col(f"{right}{i}")) for i in range(WORDS)]
    return F.coalesce(*(F.when(w != 0, F.bit_count(F.bitwise_not(w).bitwiseAND(w - 1)) + i * BITS) for i, w in enumerate(both)))


def co_subscribers(events: DataFrame, block: int = BLOCK, without: DataFrame | None = None) -> DataFrame:
    """All pairs of users that share a channel, but for those of ``without`` (user_left, user_right).

    Its result grows with the square of a channel, and so does the work, but not what is shuffled or held: a channel is
    cut into blocks of about ``block`` users, or ``GRID`` blocks of up to ``LARGEST_BLOCK`` (more only beyond that), and
    each two of them (i <= j) are a tile of their own, of which a task holds one side. A pair is
    given in the first of its channels alone, as bits of the largest channels tell, and a pair of ``without`` goes to that
    tile, so pairs are never shuffled. Only pairs that share none of the ``WORDS * BITS`` largest channels are made
    distinct by a shuffle. ``nearby_subscribers`` asks for near pairs without making the others."""
    s = _subscriptions(events)
    kind = s.schema["user_id"].dataType
    sizes = s.groupBy("channel").agg(F.count("*").alias("_n"))
    large = sizes.orderBy(F.desc("_n"), "channel").limit(WORDS * BITS)  # a bounded number of small rows
    large = large.select("channel", (F.row_number().over(Window.orderBy(F.desc("_n"), "channel")) - 1).alias("_r"))
    ranked = s.join(F.broadcast(large), "channel", "left")
    words = _words(ranked)
    sized = ranked.join(sizes.select("channel", _cuts(F.col("_n"), block).alias("_b")), "channel").join(words, "user_id")
    mine = lambda user: F.pmod(F.xxhash64(user), F.col("_b")).cast("int")
    # of a large channel's subscriber the bits of larger channels only, so common bits tell that a pair is given elsewhere
    bit = F.col("_r") % BITS
    below = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.cast("int")) - 1
    at = F.floor(F.col("_r") / BITS)
    before = lambda i: F.when(F.col("_r").isNull() | (at > i), F.col(f"_w{i}")).when(at == i, F.col(f"_w{i}").bitwiseAND(below)).otherwise(F.lit(0).cast("bigint"))
    sized = sized.select("channel", "_r", "_b", "user_id", mine("user_id").alias("_own"), *(before(i).alias(f"_w{i}") for i in range(WORDS)))
    left = sized.select("channel", "_r", F.col("user_id").alias("u"), F.col("_own").alias("i"), F.explode(F.sequence(F.col("_own"), F.col("_b") - 1)).alias("j"), *(F.col(f"_w{i}").alias(f"_u{i}") for i in range(WORDS)))
    right = sized.select("channel", F.col("user_id").alias("v"), F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("i"), F.col("_own").alias("j"), *(F.col(f"_w{i}").alias(f"_v{i}") for i in range(WORDS)))
    if without is not None:
        pair = without.select(F.col("user_left").cast(kind).alias("a"), F.col("user_right").cast(kind).alias("b"))
        side = lambda user, to: words.select(F.col("user_id").alias(user), *(F.col(f"_w{i}").alias(f"{to}{i}") for i in range(WORDS)))
        pair = pair.join(side("a", "_u"), "a").join(side("b", "_v"), "b").select("a", "b", _first_bit("_u", "_v").alias("_r")).where("_r IS NOT NULL")
        pair = pair.join(F.broadcast(large), "_r").join(sizes.select("channel", _cuts(F.col("_n"), block).alias("_b")), "channel")
        pair = pair.select("channel", "a", "b", mine("a").alias("i"), mine("b").alias("j"))
        first = (F.col("i") < F.col("j")) | ((F.col("i") == F.col("j")) & (F.col("a") < F.col("b")))
        pair = pair.select("channel", F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"), F.greatest("i", "j").alias("j"))
        # at most a block of users for each row
        left = left.join(pair.groupBy("channel", "u", "j").agg(F.collect_list("v").alias("_not")), ["channel", "u", "j"], "left")
        allowed = F.col("_not").isNull() | ~F.array_contains("_not", F.col("v"))
    else:
        allowed = F.lit(True)
    shared = reduce(lambda x, y: x.bitwiseOR(y), (F.col(f"_u{i}").bitwiseAND(F.col(f"_v{i}")) for i in range(WORDS)))
    tile = lambda l, r: l.join(r, ["channel", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("u") < F.col("v"))).where(shared == 0).where(allowed)
    ends = (F.least("u", "v").alias("user_left"), F.greatest("u", "v").alias("user_right"))
    out = tile(left.where("_r IS NOT NULL"), right).select(*ends)
    if sizes.count() > WORDS * BITS:
        rest = tile(left.where("_r IS NULL"), right).select(*ends).distinct()
        out = out.unionByName(rest if without is None else rest.join(without, ["user_left", "user_right"], "left_anti"))
    return out


def nearby_subscribers(events: DataFrame, located: DataFrame, km: float = 1.0, block: int = BLOCK) -> DataFrame:
    """Pairs that share a channel and whose places are less than ``km`` apart, with the middle between them.

    Users meet by channel and by cubes of edge ``km``: each looks into its own cube and those around it, so far
    pairs of a large channel never come up. A cube of more than ``block`` users of a channel is cut into tiles.
    """
    s = _subscriptions(events)
    s = s.join(located.select("user_id", "lat_rad", "lng_rad"), "user_id")
    x, y, z = cells(F.col("lat_rad"), F.col("lng_rad"), km)
    s = s.select("*", x.alias("cx"), y.alias("cy"), z.alias("cz"))
    cube = ["channel", "cx", "cy", "cz"]
    blocks = _blocks(s, cube, block)
    known = lambda df: df.withColumn("_b", F.lit(None).cast("int")) if blocks is None else df.join(blocks, cube, "left")
    own = lambda df: known(df).withColumn("_b", F.coalesce("_b", F.lit(1))).withColumn("_own", F.pmod(F.xxhash64("user_id"), F.col("_b")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("_b") - 1))
    shifts = F.array(*(F.struct(*(F.lit(d).alias(n) for d, n in zip((i, j, k), "xyz", strict=True))) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))
    a = s.select("channel", "user_id", "lat_rad", "lng_rad", "cx", "cy", "cz", F.explode(shifts).alias("d"))
    a = own(a.select("channel", "user_id", "lat_rad", "lng_rad", *((F.col(f"c{n}") + F.col(f"d.{n}")).alias(f"c{n}") for n in "xyz")))
    a = a.select(*cube, F.col("user_id").alias("user_left"), F.col("lat_rad").alias("lat_l"), F.col("lng_rad").alias("lng_l"), F.col("_own").alias("i"), each.alias("j"))
    b = own(s).select(*cube, F.col("user_id").alias("user_right"), F.col("lat_rad").alias("lat_r"), F.col("lng_rad").alias("lng_r"), F.col("_own").alias("j"), each.alias("i"))
    j = a.join(b, [*cube, "i", "j"]).where("user_left < user_right")
    return _close(j, km)


def _close(pairs: DataFrame, km: float) -> DataFrame:
    d = distance_km(F.col("lat_l"), F.col("lng_l"), F.col("lat_r"), F.col("lng_r"))
    near = pairs.where(d < km).select("user_left", "user_right", ((F.col("lat_l") + F.col("lat_r")) / 2).alias("lat_rad"), ((F.col("lng_l") + F.col("lng_r")) / 2).alias("lng_rad"))
    return near.distinct()


def close_pairs(pairs: DataFrame, known: DataFrame, located: DataFrame, km: float = 1.0) -> DataFrame:
    """Of given pairs, those that are no contacts and less than ``km`` apart, with the middle between them."""
    left = located.select(F.col("user_id").alias("user_left"), F.col("lat_rad").alias("lat_l"), F.col("lng_rad").alias("lng_l"))
    right = located.select(F.col("user_id").alias("user_right"), F.col("lat_rad").alias("lat_r"), F.col("lng_rad").alias("lng_r"))
    j = pairs.join(known, ["user_left", "user_right"], "left_anti").join(left, "user_left").join(right, "user_right")
    return _close(j, km)
