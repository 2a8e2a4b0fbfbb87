"""DuckDB SQL for the registered shop queries, written apart from the Spark code."""

from __future__ import annotations

_UVA = """ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
uva AS (SELECT strftime(ts, '%Y-%m-%d') AS date, user_id, user_id || '_' || strftime(ts, '%Y-%m-%d') AS session_id,
  k % 10 AS page_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS action_time,
  CASE WHEN event_type = 'view' THEN 'kw' || (k % 20) END AS search_keyword,
  CASE WHEN event_type = 'click' THEN k % 20 END AS click_category_id,
  CASE WHEN event_type = 'click' THEN k END AS click_product_id,
  CASE WHEN event_type = 'purchase' THEN (k % 20) || ',' || ((k + 7) % 20) END AS order_category_ids,
  CASE WHEN event_type = 'purchase' THEN k || ',' || ((k + 7) % 100) END AS order_product_ids,
  CASE WHEN event_type = 'signup' THEN CAST(k % 20 AS VARCHAR) END AS pay_category_ids,
  CASE WHEN event_type = 'signup' THEN CAST(k AS VARCHAR) END AS pay_product_ids,
  user_id % 25 AS city_id, event_id FROM ev),
acts AS (SELECT * FROM uva WHERE date >= '2024-01-05' AND date <= '2024-01-25'),
users AS (SELECT c_custkey AS user_id, c_name AS name, CAST(18 + c_custkey % 50 AS INTEGER) AS age, c_mktsegment AS professional,
  'city' || c_nationkey AS city, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex FROM customer),
goods AS (SELECT p_partkey AS product_id, p_name AS product_name, '{"product_status": ' || (p_size % 2) || '}' AS extend_info FROM part),
cities AS (SELECT CAST(n_nationkey AS BIGINT) AS city_id, n_name AS city_name, CASE r_name WHEN 'AFRICA' THEN 'China North' WHEN 'AMERICA' THEN 'China East'
  WHEN 'ASIA' THEN 'China South' WHEN 'EUROPE' THEN 'West North' WHEN 'MIDDLE EAST' THEN 'Northeast' ELSE r_name END AS area
  FROM nation JOIN region ON n_regionkey = r_regionkey),
clicks AS (SELECT ts, area AS province, city_name AS city, user_id, k % 10 AS ad_id, event_id, strftime(ts, '%Y-%m-%d') AS date
  FROM ev JOIN cities ON cities.city_id = ev.user_id % 25)"""


def _sessions(source: str, name: str) -> str:
    return f"""{name}_raw AS (SELECT session_id, min(user_id) AS user_id,
  list_sort(list_distinct(list(search_keyword) FILTER (WHERE search_keyword <> ''))) AS keywords,
  list_sort(list_distinct(list(click_category_id) FILTER (WHERE click_category_id IS NOT NULL))) AS categories,
  min(action_time) AS start_time, date_diff('second', CAST(min(action_time) AS TIMESTAMP), CAST(max(action_time) AS TIMESTAMP)) AS visit_length,
  count(*) AS step_length FROM {source} GROUP BY session_id),
{name} AS (SELECT session_id, user_id, coalesce(array_to_string(keywords, ','), '') AS search_keywords, coalesce(array_to_string(categories, ','), '') AS click_category_ids,
  start_time, visit_length, step_length, coalesce(keywords, []) AS keywords FROM {name}_raw)"""


_SESSIONS = _UVA + ",\n" + _sessions("acts", "sess")
_SESSION_COLUMNS = "session_id, user_id, search_keywords, click_category_ids, start_time, visit_length, step_length"
_PASSING = _SESSIONS + """,
passing AS (SELECT s.*, age, professional, city, sex FROM sess s JOIN users USING (user_id) WHERE age BETWEEN 20 AND 50 AND sex = 'male'
  AND list_has_any(keywords, ['kw1', 'kw2', 'kw3', 'kw4', 'kw5', 'kw6', 'kw7']))"""
_DETAIL = """CAST(1 AS BIGINT) AS task_id, user_id, session_id, page_id, action_time, search_keyword, click_category_id, click_product_id,
  order_category_ids, order_product_ids, pay_category_ids, pay_product_ids"""
_DRAWN = _UVA + """,
short AS (SELECT * FROM uva WHERE date >= '2024-01-05' AND date <= '2024-01-07'),
""" + _sessions("short", "sess") + """,
hours AS (SELECT substr(start_time, 1, 10) AS date, substr(start_time, 12, 2) AS hour, count(*) AS session_count FROM sess GROUP BY 1, 2),
days AS (SELECT date, sum(session_count) AS day_count FROM hours GROUP BY date),
quotas AS (SELECT date, hour, session_count, CAST(least(floor(CAST(session_count AS DOUBLE) / day_count * (100 // (SELECT count(*) FROM days))), session_count) AS BIGINT) AS quota
  FROM hours JOIN days USING (date)),
drawn AS (SELECT session_id, start_time, search_keywords, click_category_ids FROM (SELECT s.*, quota,
  row_number() OVER (PARTITION BY q.date, q.hour ORDER BY md5(session_id || '7'), session_id) AS draw
  FROM sess s JOIN quotas q ON substr(start_time, 1, 10) = q.date AND substr(start_time, 12, 2) = q.hour) WHERE draw <= quota)"""
_CATEGORIES = _UVA + """,
details AS (SELECT a.* FROM acts a JOIN users USING (user_id) WHERE sex = 'male'),
clicked AS (SELECT click_category_id AS category_id FROM details WHERE click_category_id IS NOT NULL),
ordered AS (SELECT CAST(unnest(string_split(order_category_ids, ',')) AS BIGINT) AS category_id FROM details WHERE order_category_ids IS NOT NULL),
paid AS (SELECT CAST(unnest(string_split(pay_category_ids, ',')) AS BIGINT) AS category_id FROM details WHERE pay_category_ids IS NOT NULL),
universe AS (SELECT category_id FROM clicked UNION SELECT category_id FROM ordered UNION SELECT category_id FROM paid),
click_n AS (SELECT category_id, count(*) AS click_count FROM clicked GROUP BY 1),
order_n AS (SELECT category_id, count(*) AS order_count FROM ordered GROUP BY 1),
pay_n AS (SELECT category_id, count(*) AS pay_count FROM paid GROUP BY 1),
counts AS (SELECT category_id, coalesce(click_count, 0) AS click_count, coalesce(order_count, 0) AS order_count, coalesce(pay_count, 0) AS pay_count
  FROM universe LEFT JOIN click_n USING (category_id) LEFT JOIN order_n USING (category_id) LEFT JOIN pay_n USING (category_id)),
top AS (SELECT * FROM counts ORDER BY click_count DESC, order_count DESC, pay_count DESC, category_id LIMIT 10),
best AS (SELECT category_id, session_id, click_count FROM (SELECT d.click_category_id AS category_id, session_id, count(*) AS click_count
  FROM details d WHERE d.click_category_id IN (SELECT category_id FROM top) GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY category_id ORDER BY click_count DESC, session_id) <= 10)"""
_PAGES = _UVA + """,
steps AS (SELECT session_id, page_id AS from_page, lead(page_id) OVER (PARTITION BY session_id ORDER BY action_time, event_id) AS to_page FROM uva),
splits AS (SELECT * FROM steps WHERE to_page IS NOT NULL),
flow AS (SELECT * FROM (VALUES (1, 3, 5), (2, 5, 2), (3, 2, 8)) t(position, from_page, to_page)),
pv AS (SELECT from_page, to_page, count(*) AS pv FROM splits SEMI JOIN flow USING (from_page, to_page) GROUP BY ALL),
rates AS (SELECT CAST(position AS INTEGER) AS position, CAST(from_page AS BIGINT) AS from_page, CAST(to_page AS BIGINT) AS to_page, coalesce(pv, 0) AS pv,
  coalesce(lag(coalesce(pv, 0)) OVER (ORDER BY position), (SELECT count(*) FROM uva WHERE page_id = 3)) AS before FROM flow LEFT JOIN pv USING (from_page, to_page)),
rounded AS (SELECT position, from_page, to_page, pv, CASE WHEN before > 0 THEN CAST((200 * pv + before) // (2 * before) AS DOUBLE) / 100 END AS convert_rate FROM rates)"""


def _areas(source: str) -> str:
    return f""",
basic AS (SELECT c.city_id, city_name, area, product_id FROM ({source}) s JOIN cities c ON s.city_id = c.city_id),
by_area AS (SELECT area, product_id, count(*) AS click_count, array_to_string(list_sort(list_distinct(list(city_id || ':' || city_name))), ',') AS city_infos FROM basic GROUP BY 1, 2),
full_product AS (SELECT area, product_id, click_count, city_infos, product_name,
  CASE WHEN json_extract_string(extend_info, '$.product_status') = '0' THEN 'Self' ELSE 'Third Party' END AS product_status FROM by_area JOIN goods USING (product_id))"""


_SMALL = _UVA + _areas("SELECT city_id, click_product_id AS product_id FROM acts WHERE click_product_id IS NOT NULL")
_BOUGHT = "SELECT CAST(c_nationkey AS BIGINT) AS city_id, l_partkey AS product_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
_LARGE = _UVA + _areas(_BOUGHT)
_ADS = _UVA + """,
user_ad AS (SELECT date, user_id, ad_id, count(*) AS click_count FROM clicks GROUP BY ALL),
listed AS (SELECT DISTINCT user_id FROM user_ad WHERE click_count >= 3),
stat AS (SELECT date, province, city, ad_id, count(*) AS click_count FROM clicks GROUP BY ALL),
prov AS (SELECT date, province, ad_id, CAST(sum(click_count) AS BIGINT) AS click_count FROM stat GROUP BY ALL),
prov_top AS (SELECT * FROM prov QUALIFY row_number() OVER (PARTITION BY date, province ORDER BY click_count DESC, ad_id) <= 3),
trend AS (SELECT date, strftime(ts, '%H') AS hour, strftime(ts, '%M') AS minute, ad_id, count(*) AS click_count FROM clicks GROUP BY ALL),
cur AS (SELECT * FROM stat WHERE date <= '2024-01-15'),
upd AS (SELECT date, province, city, ad_id, click_count + 10 AS click_count FROM stat WHERE date >= '2024-01-13')"""
_JOINED = f"SELECT city_id, city_name, area, count(*) AS row_count, CAST(sum(product_id) AS BIGINT) AS product_sum FROM ({_BOUGHT}) JOIN cities USING (city_id) GROUP BY ALL"

_VISIT = [("1s_3s", "BETWEEN 1 AND 3"), ("4s_6s", "BETWEEN 4 AND 6"), ("7s_9s", "BETWEEN 7 AND 9"), ("10s_30s", "BETWEEN 10 AND 30"), ("30s_60s", "BETWEEN 31 AND 60"), ("1m_3m", "BETWEEN 61 AND 180"), ("3m_10m", "BETWEEN 181 AND 600"), ("10m_30m", "BETWEEN 601 AND 1800"), ("30m", "> 1800")]
_STEP = [("1_3", "BETWEEN 1 AND 3"), ("4_6", "BETWEEN 4 AND 6"), ("7_9", "BETWEEN 7 AND 9"), ("10_30", "BETWEEN 10 AND 30"), ("30_60", "BETWEEN 31 AND 60"), ("60", "> 60")]
_BUCKETS = [(f"visit_{n}", f"visit_length {c}") for n, c in _VISIT] + [(f"step_{n}", f"step_length {c}") for n, c in _STEP]
_COUNTS = "SELECT count(*) AS session_count, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in _BUCKETS) + " FROM sess"
_RATIOS = "SELECT CAST(1 AS BIGINT) AS task_id, session_count, " + ", ".join(f"CAST((200 * {n} + session_count) // (2 * session_count) AS DOUBLE) / 100 AS {n}_ratio" for n, _ in _BUCKETS) + f" FROM ({_COUNTS})"


def _with(prefix: str, select: str) -> str:
    return f"WITH {prefix}\n{select}"


def _deliveries(late: bool = True, batches: int = 3, threshold: int = 3) -> str:
    """Replays the deliveries: each is parted into late clicks and others, and these are filtered by the list of before."""
    days = "CASE WHEN ts >= '2024-01-21' THEN 3 WHEN ts >= '2024-01-11' THEN 2 ELSE 1 END"
    too_late = "CAST(date AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM delivered o WHERE o.delivery < c.delivery)"
    parts = [f""",
delivered AS MATERIALIZED (SELECT *, CASE WHEN {days} = 1 AND event_id % 7 = 3 THEN 3 ELSE {days} END AS delivery FROM clicks),
late AS MATERIALIZED (SELECT * FROM delivered c WHERE {too_late if late else "false"}),
timely AS MATERIALIZED (SELECT * FROM delivered ANTI JOIN late USING (event_id)),
list0 AS (SELECT CAST(NULL AS BIGINT) AS user_id WHERE false)"""]
    for i in range(1, batches + 1):
        so_far = " UNION ALL ".join(f"SELECT * FROM pass{j}" for j in range(1, i + 1))
        parts.append(f"""pass{i} AS MATERIALIZED (SELECT * FROM timely WHERE delivery = {i} AND user_id NOT IN (SELECT user_id FROM list{i - 1})),
list{i} AS MATERIALIZED (SELECT DISTINCT user_id FROM (SELECT user_id FROM ({so_far}) GROUP BY date, user_id, ad_id HAVING count(*) >= {threshold}))""")
    parts.append(f"""passed AS ({" UNION ALL ".join(f"SELECT * FROM pass{i}" for i in range(1, batches + 1))}),
passed_stat AS (SELECT date, province, city, ad_id, count(*) AS click_count FROM passed GROUP BY ALL),
passed_top AS (SELECT date, province, ad_id, count(*) AS click_count FROM passed GROUP BY date, province, ad_id QUALIFY row_number() OVER (PARTITION BY date, province ORDER BY count(*) DESC, ad_id) <= 3)""")
    return ",\n".join(parts)


_CLICK = "event_id, province, city, user_id, ad_id"

ORACLES: dict[str, str] = {
    "area_top3_product": _with(_LARGE, """SELECT area, CASE WHEN area IN ('China North', 'China East') THEN 'A Level' WHEN area IN ('China South', 'China Middle') THEN 'B Level'
  WHEN area IN ('West North', 'West South') THEN 'C Level' ELSE 'D Level' END AS area_level, product_id, city_infos, click_count, product_name, product_status FROM full_product
  QUALIFY row_number() OVER (PARTITION BY area ORDER BY click_count DESC, product_id) <= 3"""),
    "actions_by_date": _with(_UVA, "SELECT * FROM acts"),
    "click_actions_by_date": _with(_UVA, "SELECT city_id, click_product_id AS product_id FROM acts WHERE click_product_id IS NOT NULL"),
    "session_aggregate": _with(_SESSIONS, f"SELECT {_SESSION_COLUMNS} FROM sess"),
    "session_full_aggregate": _with(_SESSIONS, f"SELECT {_SESSION_COLUMNS}, age, professional, city, sex FROM sess JOIN users USING (user_id)"),
    "session_filter": _with(_PASSING, f"SELECT {_SESSION_COLUMNS}, age, professional, city, sex FROM passing"),
    "session_detail": _with(_PASSING, f"SELECT {_DETAIL} FROM acts WHERE session_id IN (SELECT session_id FROM passing)"),
    "session_bucket_counts": _with(_SESSIONS, _COUNTS),
    "session_aggr_stat": _with(_SESSIONS, _RATIOS),
    "sessions_per_hour": _with(_SESSIONS, "SELECT substr(start_time, 1, 10) AS date, substr(start_time, 12, 2) AS hour, count(*) AS session_count FROM sess GROUP BY 1, 2"),
    "extract_quota": _with(_DRAWN, "SELECT date, hour, session_count, quota FROM quotas"),
    "random_extract_sessions": _with(_DRAWN, "SELECT * FROM drawn"),
    "random_extract_detail": _with(_DRAWN, f"SELECT {_DETAIL} FROM short WHERE session_id IN (SELECT session_id FROM drawn)"),
    "category_universe": _with(_CATEGORIES, "SELECT * FROM universe"),
    "click_category_counts": _with(_CATEGORIES, "SELECT * FROM click_n"),
    "order_category_counts": _with(_CATEGORIES, "SELECT * FROM order_n"),
    "pay_category_counts": _with(_CATEGORIES, "SELECT * FROM pay_n"),
    "category_counts": _with(_CATEGORIES, "SELECT * FROM counts"),
    "top10_category": _with(_CATEGORIES, "SELECT * FROM top"),
    "top10_session": _with(_CATEGORIES, "SELECT * FROM best"),
    "top10_session_detail": _with(_CATEGORIES, f"SELECT {_DETAIL.replace('session_id', 'd.session_id', 1)} FROM details d JOIN (SELECT session_id AS s, category_id AS c FROM best) ON d.session_id = s"),
    "page_splits": _with(_PAGES, "SELECT * FROM splits"),
    "ranged_page_splits": _with(_PAGES, "SELECT * FROM splits"),
    "page_split_pv": _with(_PAGES, "SELECT from_page, to_page, pv FROM pv"),
    "start_page_pv": _with(_PAGES, "SELECT count(*) AS pv FROM uva WHERE page_id = 3"),
    "page_convert_rate": _with(_PAGES, "SELECT * FROM rounded"),
    "page_convert_text": _with(_PAGES, "SELECT string_agg(from_page || '_' || to_page || '=' || coalesce(CAST(convert_rate AS VARCHAR), 'null'), '|' ORDER BY position) AS convert_rate FROM rounded"),
    "click_product_basic": _with(_SMALL, "SELECT * FROM basic"),
    "area_product_click_count": _with(_SMALL, "SELECT * FROM by_area"),
    "area_full_product": _with(_SMALL, "SELECT * FROM full_product"),
    "user_ad_click_counts": _with(_ADS, "SELECT * FROM user_ad"),
    "blacklist_users": _with(_ADS, "SELECT * FROM listed"),
    "filter_blacklist": _with(_ADS, f"SELECT {_CLICK} FROM clicks WHERE user_id NOT IN (SELECT user_id FROM listed)"),
    "apply_dynamic_blacklist": _with(_ADS, f"""SELECT {_CLICK} FROM clicks LEFT JOIN (SELECT user_id, min({{'ts': ts, 'e': event_id}}) AS crossed FROM (SELECT user_id, ts, event_id,
  count(*) OVER (PARTITION BY date, user_id, ad_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM clicks) WHERE n >= 3 GROUP BY 1) USING (user_id)
  WHERE crossed IS NULL OR {{'ts': ts, 'e': event_id}} <= crossed"""),
    "ad_stat": _with(_ADS, "SELECT * FROM stat"),
    "province_ad_counts": _with(_ADS, "SELECT * FROM prov"),
    "province_top3": _with(_ADS, "SELECT * FROM prov_top"),
    "ad_click_trend": _with(_ADS, "SELECT * FROM trend"),
    "trend_last_hour": _with(_ADS, "SELECT * FROM trend WHERE date || ' ' || hour || ':' || minute > '2024-01-15 11:00' AND date || ' ' || hour || ':' || minute <= '2024-01-15 12:00'"),
    "sliding_ad_clicks": _with(_ADS, """SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, ad_id, count(*) AS click_count
  FROM (SELECT ad_id, time_bucket(INTERVAL 10 MINUTES, ts) - to_minutes(CAST(10 * i AS INTEGER)) AS w FROM clicks, range(6) r(i)) GROUP BY ALL"""),
    "sliding_ad_clicks_by_pane": _with(_ADS, """SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, ad_id, count(*) AS click_count
  FROM (SELECT ad_id, time_bucket(INTERVAL 10 MINUTES, ts) - to_minutes(CAST(10 * i AS INTEGER)) AS w FROM clicks, range(6) r(i)) GROUP BY ALL"""),
    "busiest_windows": _with(_ADS, """SELECT ad_id, strftime(arg_min(w, {'n': -n, 'w': w}), '%Y-%m-%d %H:%M:%S') AS window_start, max(n) AS click_count, count(*) AS windows
  FROM (SELECT w, ad_id, count(*) AS n FROM (SELECT ad_id, time_bucket(INTERVAL 10 SECONDS, ts) - to_seconds(CAST(10 * i AS INTEGER)) AS w FROM clicks, range(360) r(i)) GROUP BY ALL) GROUP BY ad_id"""),
    "upsert_overwrite": _with(_ADS, "SELECT * FROM upd UNION ALL SELECT * FROM cur ANTI JOIN upd USING (date, province, city, ad_id)"),
    "upsert_add": _with(_ADS, "SELECT date, province, city, ad_id, CAST(sum(click_count) AS BIGINT) AS click_count FROM (SELECT * FROM cur UNION ALL SELECT * FROM upd) GROUP BY ALL"),
    "replace_groups": _with(_ADS, "SELECT * FROM upd WHERE ad_id < 3 UNION ALL SELECT * FROM cur WHERE (date, province) NOT IN (SELECT (date, province) FROM upd WHERE ad_id < 3)"),
    "lookup_counts": _with(_ADS, "SELECT upd.date, upd.province, upd.city, upd.ad_id, coalesce(cur.click_count, 0) AS click_count FROM upd LEFT JOIN cur USING (date, province, city, ad_id)"),
    "new_blacklist_users": _with(_ADS, "SELECT DISTINCT user_id FROM clicks WHERE user_id NOT IN (SELECT user_id FROM listed)"),
    "salted_count": f"SELECT city_id, count(*) AS row_count FROM ({_BOUGHT}) GROUP BY 1",
    "salted_join": _with(_UVA, _JOINED),
    "skew_isolated_join": _with(_UVA, _JOINED),
    "weighted_skew_join": _with(_UVA, _JOINED),
    "salted_group_concat": _with(_UVA, f"SELECT product_id, array_to_string(list_sort(list_distinct(list(city_id || ':' || city_name))), ',') AS city_infos FROM ({_BOUGHT}) JOIN cities USING (city_id) GROUP BY 1"),
    "salted_distinct": f"SELECT city_id, array_to_string(list_sort(list_distinct(list(product_id))), ',') AS product_ids, count(DISTINCT product_id) AS n_products FROM ({_BOUGHT}) GROUP BY 1",
    "date_functions": _with(_UVA, """SELECT event_id, action_time < date || ' 12:00:00' AS is_before, action_time > date || ' 12:00:00' AS is_after,
  date_diff('second', CAST(date || ' 12:00:00' AS TIMESTAMP), CAST(action_time AS TIMESTAMP)) AS seconds, CAST(0 AS BIGINT) AS unreadable, date || '_' || substr(action_time, 12, 2) AS date_hour,
  date AS date_text, action_time AS time_text, replace(date, '-', '') AS date_key, replace(date, '-', '') || substr(action_time, 12, 2) || substr(action_time, 15, 2) AS minute_key, date AS key_back FROM uva"""),
    "string_functions": _with(_UVA, """SELECT event_id, search_keyword IS NULL AS no_keyword, CAST(page_id AS VARCHAR) AS trimmed, '0' || page_id AS padded,
  city_id || ':' || coalesce(search_keyword, 'null') AS joined, replace(order_product_ids, ',', ';') AS longs, CAST((200 * event_id + 8) // 16 AS DOUBLE) / 100 AS rounded FROM uva"""),
    "json_functions": _with(_UVA, """SELECT product_id, json_extract_string(extend_info, '$.product_status') AS status, CAST(NULL AS VARCHAR) AS bad, json_extract_string(extend_info, '$.product_status') AS first,
  CASE WHEN extend_info = '{"product_status": 0}' THEN 'Self' ELSE 'Third Party' END AS label FROM goods"""),
    "concat_field_functions": _with(_UVA, """SELECT event_id, CAST(page_id AS VARCHAR) AS page, search_keyword AS kw, CAST(city_id AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS none,
  'page=' || page_id || '|kw=new|city=' || city_id AS changed, 'page=' || page_id || '|kw=' || coalesce(search_keyword, '') || '|city=' || city_id AS same FROM uva"""),
    "prefix_roundtrip": _with(_UVA, "SELECT user_id, name || '_' || city AS v, name || '_' || city AS back, CAST(length(name || '_' || city) + 2 AS INTEGER) AS salted_length FROM users"),
    "case_when_if": _with(_UVA, "SELECT user_id, age, CASE WHEN age >= 60 THEN 'A' WHEN age >= 45 THEN 'B' WHEN age >= 30 THEN 'C' ELSE 'D' END AS grade, CASE WHEN age >= 45 THEN 'GOOD' ELSE 'BAD' END AS judged FROM users"),
    "row_number_demo": _with(_UVA, "SELECT professional, user_id, age, row_number() OVER (PARTITION BY professional ORDER BY age DESC, user_id) AS rank FROM users"),
    "ad_stat_stream": _with(_ADS, "SELECT * FROM stat"),
    "ad_click_trend_stream": _with(_ADS, "SELECT * FROM trend"),
    "blacklist_stream": _with(_ADS, "SELECT * FROM listed"),
    "province_top3_stream": _with(_ADS, "SELECT * FROM prov_top"),
    "ad_job_stream": _with(_ADS + _deliveries(late=False), "SELECT * FROM passed_top"),
    "ad_chain_stream": _with(_ADS + _deliveries(), """SELECT 'stat' AS kind, date, province, city, ad_id, click_count FROM passed_stat
  UNION ALL SELECT 'top', date, province, NULL, ad_id, click_count FROM passed_top
  UNION ALL SELECT 'late', date, NULL, NULL, NULL, count(*) FROM late GROUP BY date
  UNION ALL SELECT 'listed', NULL, NULL, NULL, user_id, 1 FROM list3"""),
}
