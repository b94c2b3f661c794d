"""DuckDB SQL for the queries of the registry, written apart from the operators."""

from __future__ import annotations

_EV = """
ev AS (SELECT event_id, user_id, ts, ts::DATE AS date,
  CASE WHEN event_type IN ('view', 'purchase') THEN 'message' WHEN event_type IN ('click', 'error') THEN 'reaction' ELSE 'subscription' END AS role,
  nullif(regexp_extract(props, '"k": *([0-9]+)', 1), '') AS channel, (user_id * 7 + event_id) % 150 AS message_to,
  CASE WHEN user_id % 3 = 0 THEN user_id ELSE user_id + floor(day(ts) / 7.0)::BIGINT END AS seed FROM events),
pt AS (SELECT *, CASE WHEN event_id % 5 <> 0 THEN radians((seed * 37 % 120 - 60)::DOUBLE + user_id * 1e-5::DOUBLE) END AS lat, CASE WHEN event_id % 5 <> 0 THEN radians((seed * 53 % 300 - 150)::DOUBLE + user_id * 1e-5::DOUBLE) END AS lng FROM ev),
cities AS (SELECT n_nationkey AS city_id, n_name AS city, ['Africa/Cairo', 'America/New_York', 'Asia/Tokyo', 'Europe/Paris', 'Asia/Dubai'][n_regionkey + 1] AS timezone,
  radians((n_nationkey * 29 % 120 - 60)::DOUBLE) AS clat, radians((n_nationkey * 71 % 300 - 150)::DOUBLE) AS clng FROM nation)
"""
_DIST = "asin(sqrt(least(1.0, pow(sin(({a} - {c}) / 2), 2) + cos({a}) * cos({c}) * pow(sin(({b} - {d}) / 2), 2))))"
_NEAR = (
    "WITH "
    + _EV
    + ", best AS (SELECT event_id, cities.city_id, city, timezone FROM pt, cities WHERE lat IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY "
    + _DIST.format(a="lat", b="lng", c="clat", d="clng")
    + ", cities.city_id) = 1),\nloc AS (SELECT pt.*, city_id, city, timezone FROM pt LEFT JOIN best USING (event_id))"
)
_STAYS = (
    _NEAR
    + """, flagged AS (SELECT *, CASE WHEN lag(city_id) OVER w IS NOT DISTINCT FROM city_id THEN 0 ELSE 1 END AS f FROM loc WHERE role = 'message' AND city_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
runs AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS stay_id FROM flagged),
stays AS (SELECT user_id, stay_id, min(city_id) AS city_id, min(city) AS city, min(date) AS stay_start, max(date) AS stay_end, min(ts) AS stay_start_ts, date_diff('day', min(date), max(date)) + 1 AS stay_len FROM runs GROUP BY user_id, stay_id)"""
)

NEAREST = _NEAR + " SELECT event_id, city_id, city FROM loc"
STAYS = _STAYS + " SELECT user_id, city_id, stay_start, stay_end, stay_start_ts, stay_len::BIGINT AS stay_len FROM stays"
USERS = (
    _STAYS
    + """, now AS (SELECT user_id, city AS act_city, city_id AS act_city_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE timezone AS local_time FROM loc WHERE role = 'message' AND city_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
trips AS (SELECT user_id, count(*) AS travel_count, string_agg(city, '>' ORDER BY stay_start_ts, stay_id) AS travel_array FROM stays GROUP BY user_id),
home AS (SELECT user_id, city AS home_city, city_id AS home_city_id FROM stays WHERE stay_len >= 27 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY stay_start_ts DESC, stay_id DESC) = 1)
SELECT user_id, act_city, act_city_id, local_time, travel_count, travel_array, home_city, home_city_id FROM now FULL JOIN trips USING (user_id) LEFT JOIN home USING (user_id)"""
)
_BACK = "last_value({c} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY {o}, ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_FORE = "first_value({c} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY {o} DESC, ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_M = "CASE WHEN role = 'message' THEN 1 ELSE 0 END"
_FILLED = _NEAR + f", filled AS (SELECT * REPLACE (coalesce(city_id, {_BACK.format(c='city_id', o=_M)}, {_FORE.format(c='city_id', o=_M)}) AS city_id), city_id AS old FROM loc)"
FILL_REFERENCE = _FILLED + " SELECT event_id, city_id, CASE WHEN old IS NULL AND city_id IS NOT NULL THEN 1 ELSE 0 END AS added_city FROM filled"
_MC = "CASE WHEN role = 'message' THEN city_id END"
FILL_TIME = (
    _NEAR
    + f", filled AS (SELECT event_id, city_id AS old, coalesce(city_id, {_BACK.format(c=_MC, o='1')}, {_FORE.format(c=_MC, o='1')}) AS city_id FROM loc) SELECT event_id, city_id, CASE WHEN old IS NULL AND city_id IS NOT NULL THEN 1 ELSE 0 END AS added_city FROM filled"
)
ZONES = (
    _FILLED
    + """, e AS (SELECT *, date_trunc('month', date)::DATE AS month, date_trunc('week', date)::DATE AS week FROM filled WHERE city_id IS NOT NULL),
first AS (SELECT * FROM e WHERE role = 'message' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1),
reg AS (SELECT month, week, city_id AS zone_id, count(*) AS week_user FROM first GROUP BY ALL),
cnt AS (SELECT month, week, city_id AS zone_id, sum(CASE WHEN role = 'message' THEN 1 END)::BIGINT AS week_message, sum(CASE WHEN role = 'reaction' THEN 1 END)::BIGINT AS week_reaction, sum(CASE WHEN role = 'subscription' THEN 1 END)::BIGINT AS week_subscription FROM e GROUP BY ALL),
reg2 AS (SELECT *, (sum(week_user) OVER (PARTITION BY month, zone_id))::BIGINT AS month_user FROM reg),
cnt2 AS (SELECT *, (sum(week_message) OVER w)::BIGINT AS month_message, (sum(week_reaction) OVER w)::BIGINT AS month_reaction, (sum(week_subscription) OVER w)::BIGINT AS month_subscription FROM cnt WINDOW w AS (PARTITION BY month, zone_id))
SELECT month, week, zone_id, week_message, week_reaction, week_subscription, week_user, month_message, month_reaction, month_subscription, month_user FROM reg2 FULL JOIN cnt2 USING (month, week, zone_id)"""
)
_PAIRS = "subs AS (SELECT DISTINCT user_id, channel FROM ev WHERE role = 'subscription' AND channel IS NOT NULL), pairs AS (SELECT DISTINCT a.user_id AS user_left, b.user_id AS user_right FROM subs a JOIN subs b ON a.channel = b.channel AND a.user_id < b.user_id), con AS (SELECT DISTINCT least(user_id, message_to) AS user_left, greatest(user_id, message_to) AS user_right FROM ev WHERE role = 'message')"
CO_SUBSCRIBERS = "WITH " + _EV + ", " + _PAIRS + " SELECT user_left, user_right FROM pairs"
UNCONTACTED = "WITH " + _EV + ", " + _PAIRS + " SELECT user_left, user_right FROM pairs ANTI JOIN con USING (user_left, user_right)"
RECOMMENDATIONS = (
    "WITH "
    + _EV
    + ", "
    + _PAIRS
    + ", at AS (SELECT user_id, lat, lng FROM pt WHERE lat IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),\n".replace(" at AS", " spot AS")
    + "near AS (SELECT user_left, user_right, (l.lat + r.lat) / 2 AS mlat, (l.lng + r.lng) / 2 AS mlng FROM pairs ANTI JOIN con USING (user_left, user_right) JOIN spot l ON l.user_id = user_left JOIN spot r ON r.user_id = user_right WHERE 2 * 6371 * "
    + _DIST.format(a="l.lat", b="l.lng", c="r.lat", d="r.lng")
    + " < 1) SELECT user_left, user_right, city_id, city FROM near, cities QUALIFY row_number() OVER (PARTITION BY user_left, user_right ORDER BY "
    + _DIST.format(a="mlat", b="mlng", c="clat", d="clng")
    + ", city_id) = 1"
)
LOCAL_TIME = _NEAR + " SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE timezone AS local_time, date_trunc('week', date)::DATE AS week, date_trunc('month', date)::DATE AS month FROM loc WHERE city_id IS NOT NULL"

SETTLEMENT = """
WITH f AS (SELECT l_orderkey, l_extendedprice::DECIMAL(14,2) AS p, l_discount::DECIMAL(4,2) AS b, l_tax::DECIMAL(4,2) AS g FROM lineitem),
s AS (SELECT n_nationkey AS restaurant_id, n_name AS restaurant_name, o_orderdate::DATE AS settlement_date, count(DISTINCT o_orderkey) AS orders_count,
  sum(p)::DECIMAL(14,2) AS t, sum((p * b)::DECIMAL(14,2))::DECIMAL(14,2) AS bp, sum((p * g)::DECIMAL(14,2))::DECIMAL(14,2) AS bg
  FROM f JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  WHERE o_orderstatus = 'F' AND o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY ALL)
SELECT 1 AS launch_id, restaurant_id, restaurant_name, settlement_date, orders_count, t AS orders_total_sum, bp AS orders_bonus_payment_sum, bg AS orders_bonus_granted_sum,
  (CASE WHEN t - t * 0.25 - bp > 0 THEN t * 0.25 ELSE 0 END)::DECIMAL(14,2) AS order_processing_fee,
  (CASE WHEN t - t * 0.25 - bp > 0 THEN t - t * 0.25 - bp ELSE t - bp END)::DECIMAL(14,2) AS restaurant_reward_sum FROM s
"""
CURRENCY = """
WITH t AS (SELECT l_orderkey || '-' || l_linenumber AS operation_id, CASE WHEN o_custkey % 97 = 0 THEN -o_custkey ELSE o_custkey END AS account, (l_suppkey % 10)::INT AS cur,
  CASE WHEN l_returnflag = 'R' THEN 'chargeback' ELSE 'done' END AS status, l_quantity::INT AS amount, o_orderdate AS dt FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
one AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY operation_id, dt ORDER BY account, cur, status, amount) = 1),
days AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders WHERE day(o_orderdate) % 7 <> 0),
r AS (SELECT day, c::INT AS cur, (((c * 31 + day(day) * 7) % 900 + 100) / 1000.0)::DECIMAL(5,3) AS rate FROM days, range(0, 10) AS g(c))
SELECT dt::DATE AS date_update, one.cur AS currency_from, sum(amount * rate)::DOUBLE AS amount_total, count(amount * rate) AS cnt_transactions,
  round(count(operation_id)::DOUBLE / count(DISTINCT account), 3) AS avg_transactions_per_account, count(DISTINCT account) AS cnt_accounts_make_transactions
FROM one JOIN r ON r.day = one.dt::DATE AND r.cur = one.cur WHERE account > 0 AND status = 'done' GROUP BY 1, 2
"""
_ROWS = "WITH r AS (SELECT l_orderkey::VARCHAR AS order_id, o_custkey::VARCHAR AS user_id, p_partkey::VARCHAR AS product_id, p_name AS product_name, p_type AS category, l_linenumber AS line FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F'), u AS (SELECT DISTINCT order_id, user_id, product_id, product_name, category FROM r)"
USER_PRODUCTS = _ROWS + " SELECT user_id, product_id, product_name, count(*) AS order_cnt FROM u GROUP BY ALL"
USER_CATEGORIES = _ROWS + " SELECT user_id, category AS category_id, category AS category_name, count(DISTINCT order_id) AS order_cnt FROM u GROUP BY ALL"
LAST_IN_ORDER = "SELECT l_orderkey::VARCHAR AS order_id, l_partkey::VARCHAR AS product_id, max(l_linenumber)::INT AS line FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2"
NOTIFICATIONS = """
WITH c AS (SELECT (o_custkey % 50)::VARCHAR AS restaurant_id, *, epoch(o_orderdate)::BIGINT AS s FROM orders)
SELECT c.restaurant_id, o_orderkey::VARCHAR AS adv_campaign_id, 'campaign ' || o_orderkey AS adv_campaign_content, o_orderpriority AS adv_campaign_owner, o_custkey || '@example.com' AS adv_campaign_owner_contact,
  s AS adv_campaign_datetime_start, s + 2592000 AS adv_campaign_datetime_end, s AS datetime_created, c_custkey::VARCHAR AS client_id, 826848000::BIGINT AS trigger_datetime_created
FROM c JOIN customer ON (c_custkey % 50)::VARCHAR = c.restaurant_id WHERE s < 826848000 AND s + 2592000 > 826848000
"""


def _uuid3(text: str) -> str:
    h = f"md5(unhex('6ba7b8149dad11d180b400c04fd430c8') || encode({text}))"
    return f"(substr({h},1,8) || '-' || substr({h},9,4) || '-3' || substr({h},14,3) || '-' || substr('89ab', (('0x' || substr({h},17,1))::INT % 4) + 1, 1) || substr({h},18,3) || '-' || substr({h},21,12))"


UUID3 = f"SELECT p_partkey, {_uuid3('''p_name || '_' || p_brand''')} AS key FROM part"
HUB_KEYS = f"SELECT {_uuid3('o')} AS pk, o AS business_id FROM (SELECT DISTINCT o_orderkey::VARCHAR AS o FROM orders)"
LINK_KEYS = f"SELECT {_uuid3('''l || '_' || r''')} AS pk, l AS left_pk, r AS right_pk FROM (SELECT DISTINCT {_uuid3('o_orderkey::VARCHAR')} AS l, {_uuid3('o_custkey::VARCHAR')} AS r FROM orders)"
_CHAIN = """i AS (
  SELECT o_orderkey::VARCHAR AS o, o_custkey::VARCHAR AS u, c_name, l_partkey::VARCHAR AS p, p_name, CASE WHEN p_partkey % 25 = c_nationkey THEN p_type END AS c, l_linenumber,
    CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'O' THEN 'OPEN' ELSE 'CANCELLED' END AS s
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
)"""
_pair = lambda a, b: _uuid3(f"{_uuid3(a)} || '_' || {_uuid3(b)}")
_hub = lambda n, x: f"SELECT '{n}' AS name, {_uuid3(x)} AS pk, {x} AS said FROM (SELECT DISTINCT {x} FROM i WHERE {x} IS NOT NULL)"
_link = lambda n, a, b: f"SELECT '{n}', {_pair(a, b)}, {_uuid3(a)} || '|' || {_uuid3(b)} FROM (SELECT DISTINCT {a}, {b} FROM i WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
_sat = lambda n, k, x: f"SELECT '{n}', {_uuid3(k)}, {x} FROM (SELECT DISTINCT {k}, {x} FROM (SELECT *, c_name || '|' || lower(c_name) AS names FROM i))"
VAULT = (
    f"WITH {_CHAIN}, v AS ("
    + " UNION ALL ".join([
        _hub("h_order", "o"), _hub("h_user", "u"), _hub("h_product", "p"), _hub("h_category", "c"), _sat("s_order_status", "o", "s"), _sat("s_user_names", "u", "names"), _sat("s_product_names", "p", "p_name"),
        _link("l_order_user", "o", "u"), _link("l_order_product", "o", "p"), _link("l_product_category", "p", "c"),
    ])
    + ") SELECT *, true AS audited FROM v"
)
SATELLITE = f"SELECT {_uuid3('o_custkey::VARCHAR')} AS pk, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"
TIME_DIMENSION = "SELECT DISTINCT o_orderdate AS ts, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, day(o_orderdate)::INT AS day, strftime(o_orderdate, '%H:%M:%S') AS time, o_orderdate::DATE AS date FROM orders"
UPSERT = "SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN o_orderdate >= '1997-01-01' THEN o_orderstatus || '2' ELSE o_orderstatus END AS o_orderstatus FROM orders"
INSERT_ABSENT = "SELECT o_custkey, coalesce(min(o_orderdate) FILTER (o_orderdate >= '1999-01-01'), min(o_orderdate)) AS load_dt FROM orders GROUP BY 1"
ADD_COUNTS = "SELECT o_custkey, count(*) AS order_cnt FROM orders GROUP BY 1"
RUNNING = ADD_COUNTS
SCD1 = """
WITH a AS (SELECT * FROM orders WHERE o_orderdate < '1997-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
b AS (SELECT * FROM orders WHERE o_orderdate >= '1997-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS id, coalesce(a.o_orderdate, b.o_orderdate) AS ts, coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(b.o_orderstatus, a.o_orderstatus) AS o_orderstatus
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey
"""
_SNAPS = "s AS (SELECT l_suppkey AS restaurant_id, l_partkey AS product_id, date_trunc('year', l_shipdate)::TIMESTAMP AS update_ts, max(l_extendedprice::DECIMAL(14,2)) AS product_price FROM lineitem WHERE l_quantity > 0 GROUP BY ALL)"
SCD2 = (
    "WITH "
    + _SNAPS
    + """, grid AS (SELECT k.restaurant_id, k.product_id, t.update_ts, s.product_price FROM (SELECT DISTINCT restaurant_id, product_id FROM s) k JOIN (SELECT DISTINCT restaurant_id, update_ts FROM s) t USING (restaurant_id)
  LEFT JOIN s ON s.restaurant_id = k.restaurant_id AND s.product_id = k.product_id AND s.update_ts = t.update_ts),
c AS (SELECT *, lag(product_price) OVER (PARTITION BY restaurant_id, product_id ORDER BY update_ts) AS was FROM grid),
d AS (SELECT *, lead(update_ts) OVER w AS nxt, row_number() OVER w AS n FROM c WHERE product_price IS DISTINCT FROM was WINDOW w AS (PARTITION BY restaurant_id, product_id ORDER BY update_ts))
SELECT restaurant_id, product_id, product_price, CASE WHEN n = 1 THEN least(update_ts, TIMESTAMP '1999-01-01') ELSE update_ts END AS active_from, coalesce(nxt, TIMESTAMP '2099-12-31') AS active_to FROM d WHERE product_price IS NOT NULL"""
)
MENU_DIFF = "WITH " + _SNAPS + ", a AS (SELECT DISTINCT restaurant_id, product_id FROM s WHERE update_ts = '1996-01-01'), b AS (SELECT DISTINCT restaurant_id, product_id FROM s WHERE update_ts = '1997-01-01') SELECT coalesce(a.restaurant_id, b.restaurant_id) AS restaurant_id, coalesce(a.product_id, b.product_id) AS product_id, CASE WHEN a.product_id IS NULL THEN 'new' WHEN b.product_id IS NULL THEN 'gone' ELSE 'kept' END AS change FROM a FULL JOIN b ON a.restaurant_id = b.restaurant_id AND a.product_id = b.product_id"
CHANGED = "WITH " + _SNAPS + " SELECT i.restaurant_id, i.product_id, i.update_ts, i.product_price FROM (SELECT * FROM s WHERE update_ts = '1997-01-01') i LEFT JOIN (SELECT * FROM s WHERE update_ts = '1996-01-01') o USING (restaurant_id, product_id) WHERE o.product_price IS DISTINCT FROM i.product_price"
AS_OF = """
WITH v AS (SELECT l_partkey, active_from, max(l_suppkey) AS version FROM (SELECT *, date_trunc('month', l_shipdate)::TIMESTAMP AS active_from FROM lineitem) WHERE month(active_from) % 3 = 1 GROUP BY 1, 2),
d AS (SELECT *, least(active_from + INTERVAL 400 DAY, coalesce(lead(active_from) OVER (PARTITION BY l_partkey ORDER BY active_from), active_from + INTERVAL 400 DAY)) AS active_to FROM v)
SELECT l_orderkey, l_linenumber, l.l_partkey, l_shipdate, version, active_from AS version_from FROM lineitem l LEFT JOIN d ON d.l_partkey = l.l_partkey AND active_from <= l_shipdate AND l_shipdate < active_to
"""
INCREMENTAL = "SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey <= (SELECT max(o_orderkey) // 2 FROM orders) THEN 1 ELSE 2 END AS run, (SELECT max(o_orderkey) FROM orders) AS mark FROM orders"
PENDING = """
SELECT order_id, missing FROM (SELECT o_orderkey AS order_id, concat_ws(',', CASE WHEN c_nationkey = 3 THEN 'restaurant' END, CASE WHEN NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderdate::DATE = o.o_orderdate::DATE AND month(p.o_orderdate) <> 2) THEN 'timestamp' END, CASE WHEN o_custkey % 11 = 0 THEN 'user' END) AS missing
FROM orders o JOIN customer ON c_custkey = o_custkey WHERE c_nationkey IS NOT NULL) WHERE missing <> ''
"""
CHECKS = "SELECT * FROM (SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN NOT l_discount < 0.09 THEN 'discount' END, CASE WHEN NOT l_quantity BETWEEN 2 AND 49 THEN 'quantity' END, CASE WHEN NOT l_extendedprice > 0 THEN 'price' END) AS failed FROM lineitem) WHERE failed <> ''"
DUPLICATES = "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"
ORPHANS = "SELECT l_orderkey AS o_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')"
CANONICAL = """SELECT o_orderkey::VARCHAR AS object_id, '{"o_custkey":' || o_custkey || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '","o_orderkey":"' || o_orderkey || '","o_orderstatus":"' || o_orderstatus || '"}' AS object_value FROM orders"""
ORDER_ITEMS = "SELECT l_orderkey::VARCHAR AS order_id, count(*) AS n, sum((l_quantity::INT * l_extendedprice::DECIMAL(14,2))::DECIMAL(14,2))::DOUBLE AS total FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1"
SALES = """
WITH f AS (SELECT l_orderkey AS order_id, l_partkey AS product_id, sum(l_quantity::INT)::INT AS count, sum(l_extendedprice::DECIMAL(14,2)) AS t, sum((l_extendedprice::DECIMAL(14,2) * l_discount::DECIMAL(4,2))::DECIMAL(14,2)) AS bp, sum((l_extendedprice::DECIMAL(14,2) * l_tax::DECIMAL(4,2))::DECIMAL(14,2)) AS bg
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND o_orderdate >= '1999-01-01' GROUP BY ALL)
SELECT order_id, product_id, f.count, t::DOUBLE AS total_sum, CASE WHEN product_id % 2 = 0 THEN bp ELSE 0 END::DOUBLE AS bonus_payment, CASE WHEN product_id % 2 = 0 THEN bg ELSE 0 END::DOUBLE AS bonus_grant FROM f JOIN part ON p_partkey = product_id
"""
