"""URL filters by temporal list join: every capture is judged by the list entries in force when it was fetched.

Dated entries (list, pattern, action add or remove, time) become validity intervals per list and pattern. The
intervals that can concern a host, those of the host and of all its parent domains, are gathered for each distinct
host; captures then meet their host's intervals in one equi-join and pick those that hold at their time. The hosts'
side is broadcast only if its counted rows and summed bytes are within bounds; otherwise both sides are shuffled, and Spark
splits the captures of a hot host, as the other side has one row for it.

Defined results: a capture without a host or time is judged by nothing and not listed; entries without a list,
pattern, time or known action are ignored; of several entries of a list and pattern at one time a removal wins;
repeated captures are judged one by one; patterns are host names, lower case, and match their subdomains too;
without entries nothing is listed; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.columns import others, unused

BROADCAST_ROWS = 100_000
#: The summed length of hosts with their intervals up to which they are broadcast.
BROADCAST_BYTES = 30_000_000
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    """The host of an absolute URL, lower case; null if there is none."""
    h = F.regexp_extract(F.lower(url), HOST, 1)
    return F.when(h != "", F.rtrim(h, F.lit(".")))


def validity(entries: DataFrame) -> DataFrame:
    """(list, pattern, valid_from, valid_to): from an addition to the next removal, half open; null is open-ended."""
    e = entries.where("list IS NOT NULL AND pattern IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
    e = e.groupBy("list", F.lower("pattern").alias("pattern"), "at").agg(F.max("action").alias("action"))
    w = Window.partitionBy("list", "pattern").orderBy("at")
    # repeated additions keep the first; each interval ends at the next change to a removal
    e = e.withColumn("was", F.lag("action").over(w)).where(F.col("was").isNull() | (F.col("was") != F.col("action")))
    e = e.withColumn("valid_to", F.lead("at").over(w)).where("action = 'add'")
    return e.select("list", "pattern", F.col("at").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``captures`` with host, n_matches, listed, and the deciding entry: the longest pattern, then the newest."""
    rest = [F.col(f"`{c}`") for c in others(captures, "host", "n_matches", "listed", "list", "pattern", "valid_from")]
    c = captures.select(*rest, host_of(F.col(f"`{url}`")).alias("host"))
    hosts = c.where("host IS NOT NULL").select("host").distinct()
    labels = F.split("host", r"\.")
    parents = hosts.select(
        "host",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("pattern"),
    )
    k, o, w = unused(captures, "_known", "_host", "_now")
    known = parents.join(validity(entries), "pattern").groupBy("host").agg(
        F.collect_list(
            F.struct(F.length("pattern").alias("size"), "valid_from", "list", "pattern", "valid_to")
        ).alias(k)
    )
    known = known.withColumnRenamed("host", o)
    of = lambda x: F.octet_length(x["list"]) + F.octet_length(x["pattern"]) + 64
    held = F.octet_length(o) + 32 + F.aggregate(k, F.lit(0).cast("long"), lambda n, x: n + of(x))
    n, total = known.agg(F.count("*"), F.sum(held)).first()
    if n <= broadcast_rows and (total or 0) <= BROADCAST_BYTES:
        known = F.broadcast(known)
    j = c.join(known, c.host == known[o], "left")
    when = F.col(f"`{at}`")
    now = F.filter(k, lambda x: (x["valid_from"] <= when) & (x["valid_to"].isNull() | (when < x["valid_to"])))
    j = j.select(*rest, "host", F.explode(F.array(F.coalesce(now, F.slice(k, 1, 0)))).alias(w))
    top = F.array_max(w)
    n = F.coalesce(F.size(w), F.lit(0))
    return j.select(
        *rest,
        "host",
        F.greatest(n, F.lit(0)).cast("long").alias("n_matches"),
        (n > 0).alias("listed"),
        top["list"].alias("list"),
        top["pattern"].alias("pattern"),
        top["valid_from"].alias("valid_from"),
    )


def _day(n: Column) -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + n * 86400)


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time, one of the hours of 2024 by their id: the table itself has none."""
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(8784)) * 3600).alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list derived from the pages' own hosts and their parent domains, as the tables have none.

    The first sixteen bits of a name's MD5 decide whether and when it is added, removed and added again.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    names = hosts.select("host").unionByName(hosts.select(F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("host")))
    names = names.where("host <> ''").distinct()
    k = F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("long")
    names = names.select("host", k.alias("k")).where("k % 3 <> 1")
    name = F.when(F.col("k") % 2 == 0, "spam").otherwise("adult")
    event = lambda action, day: F.struct(F.lit(action).alias("action"), _day(F.col("k") % 200 + day).alias("at"))
    all_events = F.array(event("add", 0), event("remove", 60), event("add", 120))
    events = F.when(F.col("k") % 5 == 0, F.slice(all_events, 1, 1)).when(F.col("k") % 5 == 1, F.slice(all_events, 1, 2)).otherwise(all_events)
    return names.select(name.alias("list"), F.col("host").alias("pattern"), F.inline(events))


def digest(pages: DataFrame) -> DataFrame:
    """Every page with its verdict at its fetch time."""
    return judge(captures_of(pages), entries_of(pages))


ORACLE = r"""
WITH p AS (SELECT page_id, url, to_timestamp(1704067200 + ((page_id * 7919) % 8784) * 3600) AT TIME ZONE 'UTC' AS fetched_at,
  nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '.'), '') AS host FROM pages),
names AS (SELECT host AS name FROM p WHERE host IS NOT NULL UNION SELECT regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) FROM p WHERE host IS NOT NULL),
k AS (SELECT name, ('0x' || substr(md5(name), 1, 4))::BIGINT AS k FROM names WHERE name <> ''),
ev AS (SELECT name, CASE WHEN k % 2 = 0 THEN 'spam' ELSE 'adult' END AS list, action, to_timestamp(1704067200 + (k % 200 + d) * 86400) AT TIME ZONE 'UTC' AS ts
  FROM k, (VALUES ('add', 0), ('remove', 60), ('add', 120)) AS v(action, d)
  WHERE k % 3 <> 1 AND (d = 0 OR (k % 5 <> 0 AND (d = 60 OR k % 5 <> 1)))),
iv AS (SELECT * FROM (SELECT name, list, action, ts AS valid_from, lead(ts) OVER (PARTITION BY name, list ORDER BY ts) AS valid_to FROM ev) WHERE action = 'add'),
m AS (SELECT p.page_id, iv.*, count(*) OVER (PARTITION BY p.page_id) AS n, row_number() OVER (PARTITION BY p.page_id ORDER BY length(name) DESC, valid_from DESC, list DESC) AS rn
  FROM p JOIN iv ON (p.host = iv.name OR ends_with(p.host, '.' || iv.name)) AND iv.valid_from <= p.fetched_at AND (iv.valid_to IS NULL OR p.fetched_at < iv.valid_to))
SELECT p.page_id, p.url, p.fetched_at, p.host, coalesce(m.n, 0)::BIGINT AS n_matches, m.n IS NOT NULL AS listed, m.list, m.name AS pattern, m.valid_from
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.rn = 1
"""
