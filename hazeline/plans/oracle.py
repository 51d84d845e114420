"""The same questions in plain SQL, written from the definitions: joins where the queries stack, windows where they use
``max_by``.  Queries that fit models have no twin."""

from __future__ import annotations

COUNTS = "admissions confirmed undetermined symptomatic deaths deaths_confirmed".split()
_SUMS = """count(*) AS admissions, count(*) FILTER (confirmed) AS confirmed, count(*) FILTER (undetermined) AS undetermined,
  count(*) FILTER (symptomatic) AS symptomatic, count(*) FILTER (died) AS deaths,
  count(*) FILTER (died_confirmed) AS deaths_confirmed"""
_ZERO = ", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in COUNTS)
_NULL_MEAN = "CASE WHEN count(*) = count({0}) THEN avg({0}) END"
_NULL_SUM = "CASE WHEN count(*) = count({0}) THEN sum({0}) END"
_WEEKS = "(SELECT unnest(generate_series(0, 4))::INT AS week) w"
_MONTHS = "(SELECT unnest(generate_series(1, 12))::INT AS month) m"
_A, _B = "ln(1.026::DOUBLE)", "ln(1.020::DOUBLE)"
_CAPITALS = "('3','14','15','92','65','35','89','79','32')"


def _with(*ctes: str, select: str) -> str:
    seen, out = set(), []
    for c in ctes:
        for part in c.split("\n--\n"):
            part = part.strip().rstrip(",")
            if part and part not in seen:
                seen.add(part)
                out.append(part)
    return "WITH " + ",\n".join(out) + "\n" + select


EVENT_CASES = """
ev_case AS (SELECT zone, date, confirmed, NOT confirmed AS undetermined, confirmed OR value > 50 AS symptomatic, died,
    died AND confirmed AS died_confirmed
  FROM (SELECT user_id::VARCHAR AS zone, ts::DATE AS date, event_type = 'purchase' AS confirmed, value, value < 10 AS died
        FROM events WHERE event_type IN ('error', 'purchase')))
--
ev_count AS (SELECT zone, date, %s FROM ev_case GROUP BY zone, date)
--
ev_axis AS (SELECT unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM ev_case)
--
ev_dense AS (SELECT zone, date, %s FROM
  (SELECT z.zone, a.date FROM (SELECT DISTINCT zone FROM ev_case) z, ev_axis a) LEFT JOIN ev_count USING (zone, date))
""" % (_SUMS, _ZERO)

EVENT_DAILY = EVENT_CASES + """
--
ev_read AS (SELECT user_id::VARCHAR AS zone, ts::DATE AS date, round(value * 100) AS reading FROM events)
--
ev_day AS (SELECT coalesce(c.zone, r.zone) AS zone, coalesce(c.date, r.date) AS date, %s, r.reading, r.reading > 5000 AS above
  FROM ev_dense c FULL JOIN (SELECT zone, date, avg(reading) AS reading FROM ev_read GROUP BY ALL) r
    ON c.zone = r.zone AND c.date = r.date)
""" % _ZERO

_ROLL = ", ".join(f"sum({c})::BIGINT AS {c}" for c in COUNTS)
EVENT_WEEK = EVENT_DAILY + f"""
--
ev_week AS (SELECT zone, ((day(date) - 1) // 7)::INT AS week, {_ROLL}, {_NULL_MEAN.format('reading')} AS reading,
    CASE WHEN count(*) = count(above) THEN count(*) FILTER (above) END AS days_above
  FROM ev_day GROUP BY zone, ((day(date) - 1) // 7)::INT)
"""

COUNTER = """
counter AS (SELECT user_id::VARCHAR AS zone, ts::DATE AS date, ts, event_id, round(value * 100)::BIGINT AS cases,
    regexp_extract(props, '[0-9]+')::BIGINT AS deaths
  FROM events WHERE event_type = 'purchase')
"""

INCREMENTS = COUNTER + f"""
--
shifted AS (SELECT zone, date_diff('day', DATE '2023-12-18', (date - 14)::DATE) // 7 AS week, ts, event_id, cases, deaths
  FROM counter WHERE date - 14 BETWEEN DATE '2023-12-18' AND DATE '2024-01-16')
--
newest AS (SELECT zone, week, cases, deaths FROM shifted
  QUALIFY row_number() OVER (PARTITION BY zone, week ORDER BY ts DESC, event_id DESC) = 1)
--
counted AS (SELECT zone, week, CASE WHEN week = 0 THEN 0 ELSE cases END AS cases, CASE WHEN week = 0 THEN 0 ELSE deaths END AS deaths
  FROM (SELECT z.zone, w.week FROM (SELECT DISTINCT zone FROM newest) z, {_WEEKS}) LEFT JOIN newest USING (zone, week))
--
carried AS (SELECT zone, week,
    last_value(cases IGNORE NULLS) OVER (PARTITION BY zone ORDER BY week ROWS UNBOUNDED PRECEDING) AS cases_total,
    last_value(deaths IGNORE NULLS) OVER (PARTITION BY zone ORDER BY week ROWS UNBOUNDED PRECEDING) AS deaths_total FROM counted)
--
incr AS (SELECT zone, week, cases_total, deaths_total,
    greatest(coalesce(cases_total - lag(cases_total) OVER (PARTITION BY zone ORDER BY week), 0), 0) AS cases_new,
    greatest(coalesce(deaths_total - lag(deaths_total) OVER (PARTITION BY zone ORDER BY week), 0), 0) AS deaths_new FROM carried)
"""

CENSUS = """
census AS (SELECT c_custkey::VARCHAR AS zone, c_name AS name, n_name AS state, c_acctbal / 10000 AS idhm,
    (c_custkey % 20 + 60)::DOUBLE AS espvida, c_acctbal AS rdpc, (c_custkey % 100) / 100.0::DOUBLE AS gini, pop,
    CASE WHEN pop < 2500 THEN 'p' WHEN pop < 5000 THEN 'm' ELSE 'g' END AS size
  FROM (SELECT *, CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal)::BIGINT END AS pop FROM customer)
    JOIN nation ON c_nationkey = n_nationkey)
"""


def _cut(period: str, expr: str, axis: str) -> str:
    return f"""
cut AS (SELECT strip_accents(upper(CASE WHEN o_totalprice > 480000 THEN spelt || ' ?' ELSE spelt END)) AS name, state,
    {expr} AS {period}, area
  FROM (SELECT o_totalprice, o_orderdate, n_name AS state, round(o_totalprice * 100) AS area,
      CASE WHEN o_orderpriority < '3' THEN translate(lower(c_name), 'aeou', 'áéõü') ELSE c_name END AS spelt
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey))
--
cut_area AS (SELECT k.zone, {period}, coalesce(area, 0) AS area
  FROM (SELECT * FROM (SELECT DISTINCT name, state FROM cut), {axis})
    LEFT JOIN (SELECT name, state, {period}, sum(area) AS area FROM cut GROUP BY ALL) USING (name, state, {period})
    JOIN (SELECT zone, upper(name) AS name, state FROM census) k USING (name, state))
"""


BASE = EVENT_WEEK + "--\n" + INCREMENTS + "--\n" + CENSUS + "--\n" + _cut("week", "((day(o_orderdate) - 1) // 7)::INT", _WEEKS) + f"""
--
fire AS (SELECT zone, week, coalesce(n, 0)::BIGINT AS n_fires, coalesce(v, 0) AS fire_density
  FROM (SELECT z.zone, w.week FROM (SELECT DISTINCT user_id::VARCHAR AS zone FROM events WHERE event_type = 'click') z, {_WEEKS})
    LEFT JOIN (SELECT user_id::VARCHAR AS zone, ((day(ts) - 1) // 7)::INT AS week, count(*) AS n, sum(round(value * 100)) AS v
      FROM events WHERE event_type = 'click' GROUP BY ALL) USING (zone, week))
--
rain AS (SELECT zone, week, v AS precipitation
  FROM (SELECT z.zone, w.week FROM (SELECT DISTINCT user_id::VARCHAR AS zone FROM events WHERE event_type = 'view') z, {_WEEKS})
    LEFT JOIN (SELECT user_id::VARCHAR AS zone, ((day(ts) - 1) // 7)::INT AS week, sum(round(value * 100)) AS v
      FROM events WHERE event_type = 'view' GROUP BY ALL) USING (zone, week))
--
base AS (SELECT p.*, c.* EXCLUDE (zone), p.zone IN {_CAPITALS} AS capital,
    CASE WHEN f.n_fires = 0 THEN 1 ELSE f.n_fires END AS n_fires, f.fire_density, i.* EXCLUDE (zone, week), r.precipitation,
    coalesce(a.area, 0) AS area
  FROM ev_week p LEFT JOIN census c ON p.zone = c.zone
    LEFT JOIN fire f ON p.zone = f.zone AND p.week = f.week LEFT JOIN incr i ON p.zone = i.zone AND p.week = i.week
    LEFT JOIN rain r ON p.zone = r.zone AND p.week = r.week LEFT JOIN cut_area a ON p.zone = a.zone AND p.week = a.week)
--
season AS (SELECT * FROM base WHERE week BETWEEN 1 AND 3)
--
flagged AS (SELECT zone FROM season GROUP BY zone HAVING {_NULL_MEAN.format('days_above')} >= 2)
"""
MONITORED = """
monitored AS (SELECT * FROM base WHERE week = 4 AND (days_above IS NOT NULL OR state NOT SIMILAR TO '.*[02468]'))
"""
_STATES = "state IN (" + ", ".join(f"'NATION_{i}'" for i in range(10)) + ")"


def _line_list(shipped: str) -> str:
    join = "LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"
    return f"""
ll AS (SELECT o_orderkey, zone, admitted, (admitted - 7)::DATE AS exposed, outcome, closed,
    coalesce(class NOT IN (1, 2, 3), true) AS undetermined, coalesce(class = 5, false) AS confirmed, status = 'F' AS died, urgency <= 2 AS fever,
    (k % 2 = 0)::INT + (k % 3 = 0)::INT + (k % 7 = 0)::INT + (urgency = 1)::INT + (k % 13 = 1)::INT + (k % 17 = 0)::INT AS n_symptoms, pcr
  FROM (SELECT o_orderkey, o_orderkey AS k, o_custkey::VARCHAR AS zone, substr(o_orderpriority, 1, 1)::INT AS urgency,
      o_orderstatus AS status, CASE WHEN o_totalprice >= 5000 THEN o_orderdate::DATE END AS admitted,
      CASE WHEN o_orderpriority <> '5-LOW' THEN {shipped}::DATE END AS outcome, {shipped}::DATE AS closed,
      CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 11 IN (1, 2, 3) THEN 5 WHEN o_orderkey % 11 = 4 THEN 4
        ELSE instr('FOP', o_orderstatus) END AS class,
      CASE WHEN o_orderkey % 5 = 1 THEN 2 WHEN o_orderkey % 5 IN (2, 3) THEN 1 END AS pcr
    FROM orders {join if shipped == 'shipped' else ''}))
--
cases AS (SELECT *, (confirmed OR (undetermined AND fever AND n_symptoms > 0)) AND coalesce(pcr <> 2, true) AS symptomatic,
    died AND confirmed AS died_confirmed FROM ll WHERE exposed BETWEEN DATE '1995-01-01' AND DATE '2001-12-31')
"""


OUTCOME = _line_list("shipped") + """
--
out_axis AS (SELECT unnest(generate_series(TIMESTAMP '1998-01-01', TIMESTAMP '1998-12-31', INTERVAL 1 DAY))::DATE AS date)
--
out_count AS (SELECT zone, outcome AS date, %s FROM cases GROUP BY zone, outcome)
--
out_dense AS (SELECT coalesce(g.zone, c.zone) AS zone, coalesce(g.date, c.date) AS date, %s
  FROM (SELECT z.zone, a.date FROM (SELECT DISTINCT zone FROM cases) z, out_axis a) g FULL JOIN out_count c ON g.zone = c.zone AND g.date = c.date)
--
order_day AS (SELECT o_custkey::VARCHAR AS zone, o_orderdate::DATE AS date, avg(round(o_totalprice * 100)) AS reading FROM orders GROUP BY ALL)
""" % (_SUMS, _ZERO)

ORDER_COUNTER = f"""
oc_new AS (SELECT o_custkey::VARCHAR AS zone, month(o_orderdate::DATE - 14)::INT AS month, round(o_totalprice * 100)::BIGINT AS cases
  FROM orders WHERE o_orderdate::DATE - 14 BETWEEN DATE '1994-12-01' AND DATE '2001-12-31'
  QUALIFY row_number() OVER (PARTITION BY o_custkey, month(o_orderdate::DATE - 14) ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
--
oc_set AS (SELECT zone, month, CASE WHEN month = 1 THEN 0 ELSE cases END AS cases
  FROM (SELECT z.zone, m.month FROM (SELECT DISTINCT zone FROM oc_new) z, {_MONTHS}) LEFT JOIN oc_new USING (zone, month))
--
oc_fill AS (SELECT zone, month, last_value(cases IGNORE NULLS) OVER (PARTITION BY zone ORDER BY month ROWS UNBOUNDED PRECEDING) AS cases_total
  FROM oc_set)
--
oc AS (SELECT *, greatest(coalesce(cases_total - lag(cases_total) OVER (PARTITION BY zone ORDER BY month), 0), 0) AS cases_new FROM oc_fill)
"""

PROFILE_COLUMNS = "admissions reading days_above precipitation area pop n_fires".split()
PROFILE = f"""
per_order AS (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1)
--
zone_month AS (SELECT o_custkey, year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS admissions, avg(round(o_totalprice * 100)) AS reading,
    count(*) FILTER (o_totalprice > 300000) AS days_above, sum(quantity) AS precipitation, sum(coalesce(n_lines, 0)) AS n_fires,
    max(round(o_totalprice * 100)) AS area
  FROM orders LEFT JOIN per_order ON l_orderkey = o_orderkey GROUP BY ALL)
--
profile AS (SELECT c_custkey::VARCHAR AS zone, {', '.join(f'avg({c}) AS {c}' for c in PROFILE_COLUMNS)}
  FROM (SELECT *, round(c_acctbal * 100) AS pop FROM zone_month JOIN customer ON o_custkey = c_custkey)
  WHERE m BETWEEN 7 AND 10 AND precipitation IS NOT NULL GROUP BY 1)
"""

GRID = """
bands AS (SELECT event_id, user_id % 10 AS cell_x, user_id // 10 AS cell_y, ts AS run_ts,
    date_trunc('hour', ts) - to_hours((hour(ts) % 3)::INT) AS band_ts, round(value * 100) * 1e-9::DOUBLE * 1e9::DOUBLE AS value FROM events)
--
grid AS (SELECT *, band_ts::DATE AS date_utc, (band_ts - INTERVAL 5 HOURS)::DATE AS date_local FROM bands)
--
grid_day AS (SELECT cell_x, cell_y, date_utc AS date, avg(value) AS value FROM grid GROUP BY ALL)
"""

COVER = """
shape AS (SELECT s_suppkey AS polygon, (s_suppkey * 7) % 10 + 0.5::DOUBLE + s_acctbal / 10000 / 3 AS cx,
    s_suppkey * 0.15::DOUBLE + s_acctbal / 10000 / 7 AS cy, 0.8::DOUBLE + s_acctbal / 10000 * 0.9::DOUBLE AS r, s_acctbal FROM supplier)
--
corner AS (SELECT * FROM (VALUES (0, 0, -1.0::DOUBLE, -0.7::DOUBLE), (0, 1, 0.13, -0.31), (0, 2, 1.0, -0.9), (0, 3, 0.77, 0.83), (0, 4, -0.6, 1.1),
  (1, 0, -0.17, 0.1), (1, 1, -0.15, 0.41), (1, 2, 0.19, 0.37), (1, 3, 0.17, 0.12)) t(ring_id, i, px, py))
--
vertex AS (SELECT polygon, ring_id, i, cx + r * px AS x, cy + r * py AS y FROM shape, corner WHERE ring_id = 0 OR s_acctbal > 6000)
--
edge AS (SELECT v.polygon, v.ring_id, v.x AS ax, v.y AS ay, n.x AS bx, n.y AS by_ FROM vertex v JOIN vertex n
    ON v.polygon = n.polygon AND v.ring_id = n.ring_id AND n.i = (v.i + 1) % (CASE WHEN v.ring_id = 0 THEN 5 ELSE 4 END))
--
box AS (SELECT polygon, floor(min(x))::BIGINT AS x0, ceil(max(x))::BIGINT - 1 AS x1, floor(min(y))::BIGINT AS y0, ceil(max(y))::BIGINT - 1 AS y1 FROM vertex GROUP BY 1)
--
box_cell AS (SELECT polygon, x AS cell_x, unnest(generate_series(y0, y1)) AS cell_y FROM (SELECT *, unnest(generate_series(x0, x1)) AS x FROM box))
--
piece AS (SELECT polygon, ring_id, cell_x, cell_y, sign(bx - ax) * (x2 - x1) AS w, ay + s * (x1 - ax) - cell_y AS u1, ay + s * (x2 - ax) - cell_y AS u2
  FROM (SELECT *, (by_ - ay) / (bx - ax) AS s, greatest(least(ax, bx), cell_x::DOUBLE) AS x1, least(greatest(ax, bx), cell_x + 1.0::DOUBLE) AS x2
        FROM edge JOIN box_cell USING (polygon) WHERE ax <> bx) WHERE x2 > x1)
--
ring_cov AS (SELECT polygon, ring_id, cell_x, cell_y, sum(w * CASE WHEN abs(u2 - u1) < 1e-12 THEN greatest(0, least(1, u1))
    ELSE ((CASE WHEN u2 <= 0 THEN 0 WHEN u2 < 1 THEN u2 * u2 / 2 ELSE u2 - 0.5 END) - (CASE WHEN u1 <= 0 THEN 0 WHEN u1 < 1 THEN u1 * u1 / 2 ELSE u1 - 0.5 END)) / (u2 - u1) END) AS c
  FROM piece GROUP BY ALL)
--
cover AS (SELECT * FROM (SELECT polygon, cell_x, cell_y, sum(CASE WHEN ring_id = 0 THEN abs(c) ELSE -abs(c) END) AS cov FROM ring_cov GROUP BY ALL) WHERE cov > 1e-9)
"""

STATS = GRID + "--\n" + COVER + """
--
hit AS (SELECT polygon, date, value, cov, round(cov * 1000000000)::BIGINT AS w FROM grid_day JOIN cover USING (cell_x, cell_y))
--
cum AS (SELECT *, sum(w) OVER (PARTITION BY polygon, date ORDER BY value RANGE UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY polygon, date) AS t FROM hit)
--
stats AS (SELECT polygon, date, 'mean' AS fun, sum(value * cov) / sum(cov) AS value FROM hit GROUP BY ALL
  UNION ALL SELECT polygon, date, 'max', max(value) FROM hit GROUP BY ALL
  UNION ALL SELECT polygon, date, 'median', min(value) FROM cum WHERE 2 * c >= t GROUP BY ALL)
"""


def _r(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def _half_up(x: str) -> str:
    return f"(CASE WHEN count(*) = count({x}) THEN ((200 * sum({x}) + count(*)) // (2 * count(*)))::DOUBLE / 100.0::DOUBLE END)"


def _pct(days: str, text: bool = True) -> str:
    out = []
    for name, b in (("admissions", _A), ("confirmed", _B)):
        x = f"exp({b} * {days}) - 1"
        out.append((f"printf('%.1f', ({x}) * 100) || '%'" if text else f"round({x}, 6)") + f" AS pct_{name}")
    return ", ".join(out)


def _totals(rows: str, keys: str, measures: list[str]) -> str:
    ints = ", ".join(
        f"({_NULL_SUM.format(m)})::BIGINT AS total_{m}, {_NULL_MEAN.format(m)} AS mean_{m}" for m in measures)
    means = _r(*[f"mean_{m}" for m in measures])
    totals = ", ".join(f"total_{m}" for m in measures)
    return f"SELECT {keys}, {totals}, {means}, {_pct('mean_days_above', False)} FROM (SELECT {keys}, {ints} FROM {rows} GROUP BY {keys})"


_KEYS = "zone, name, state, pop"
_DAY_COUNTS = ", ".join(COUNTS)

ORACLE: dict[str, str] = {
    "scan_drop_cols": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_shipdate FROM lineitem",
    "incremental_anti": """SELECT DISTINCT user_id::VARCHAR AS zone, ts::DATE AS date FROM events
      WHERE (user_id, ts::DATE) NOT IN (SELECT user_id, ts::DATE FROM events WHERE event_type = 'view')""",
    "clean_readings": "SELECT event_id, round(value, 2) AS reading FROM events WHERE event_type <> 'error' AND value <= 300",
    "semi_zone_filter": """SELECT o_custkey AS zone, o_orderkey, o_totalprice FROM orders
      WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
    "distinct_zones": "SELECT DISTINCT c_mktsegment FROM customer ORDER BY 1",
    "zone_surrogate_id": "SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS zone_id FROM customer",
    "exceedance_flag": "SELECT event_id, CASE WHEN event_type <> 'error' THEN value > 50 END AS above FROM events",
    "string_keys": """SELECT c_custkey, lpad(c_custkey::VARCHAR, 9, '0') AS zone, substr((c_custkey + 1000000)::VARCHAR, 1, 6) AS zone6,
        'ymd_' || c_mktsegment || '_' || c_nationkey AS label, split_part(c_name, '#', 2) AS part,
        regexp_extract(c_name, '[0-9]+')::INT + 1 AS number,
        upper(strip_accents(CASE WHEN c_acctbal < 0 THEN spelt || ' ?' ELSE spelt END)) AS name_key,
        regexp_replace(c_name, '0+', '_', 'g') AS squeezed, replace(c_mktsegment, 'U', '-') AS replaced,
        c_nationkey::DOUBLE AS nation_number, try_cast(c_mktsegment AS DOUBLE) AS not_a_number
      FROM (SELECT *, CASE WHEN c_mktsegment < 'G' THEN translate(lower(c_name), 'aeou', 'áéõü') ELSE c_name END AS spelt FROM customer)""",
    "date_parts": """SELECT o_orderkey, try_strptime(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '31/02/1999' ELSE strftime(o_orderdate, '%d/%m/%Y') END,
          '%d/%m/%Y')::DATE AS parsed, day, year(day)::INT AS year, month(day)::INT AS month, (day - 7)::DATE AS exposed, (day - 14)::DATE AS reported,
        date_diff('day', DATE '1995-01-01', day)::INT AS days, strftime(local, '%H:%M:%S') AS clock, local::DATE AS local_date,
        day(last_day(day))::INT AS month_days
      FROM (SELECT o_orderkey, o_orderpriority, o_orderdate, o_orderdate::DATE AS day, o_orderdate + to_hours((o_orderkey % 24)::INT) - INTERVAL 5 HOURS AS local FROM orders)""",
    "clamp_values": """SELECT o_orderkey, x, y, CASE WHEN x < 0 THEN 0 ELSE x END AS clamped, CASE WHEN x = 0 THEN 1 ELSE x END AS at_least_one,
        CASE WHEN y = 0 THEN 0.01::DOUBLE ELSE y::DOUBLE END AS not_zero, coalesce(x, y) AS either, coalesce(y, 0) AS filled
      FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice / 1000)::BIGINT - 250 END AS x,
              CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN substr(o_orderpriority, 1, 1)::BIGINT - 1 END AS y FROM orders)""",
    "rate_ratio": f"""SELECT o_orderkey, days, round(exp({_A} * days), 6) AS ratio, round(exp({_A} * days) - 1, 6) AS extra,
        printf('%.1f', (exp({_A} * days) - 1) * 100) || '%' AS shown, round(CASE WHEN o_totalprice > 0 THEN ln(o_totalprice) END, 6) AS "offset"
      FROM (SELECT o_orderkey, o_totalprice, o_orderkey % 31 AS days FROM orders)""",
    "classify_cases": _with(_line_list("NULL"), select="""SELECT o_orderkey, zone, exposed, n_symptoms, confirmed, undetermined, symptomatic, died,
        died_confirmed FROM cases"""),
    "daily_counts": _with(EVENT_CASES, select=f"SELECT zone, date, {_DAY_COUNTS} FROM ev_dense"),
    "daily_counts_by_outcome": _with(OUTCOME, select=f"SELECT zone, date AS outcome_date, {_DAY_COUNTS} FROM out_dense"),
    "complete_observed_range": """WITH r AS (SELECT user_id::VARCHAR AS zone, ts::DATE AS date, round(value * 100) AS reading FROM events),
      a AS (SELECT unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM r)
      SELECT zone, date, coalesce(reading, 0) AS reading FROM (SELECT z.zone, a.date FROM (SELECT DISTINCT zone FROM r) z, a) LEFT JOIN r USING (zone, date)""",
    "complete_fixed_range": """WITH r AS (SELECT user_id::VARCHAR AS zone, ts::DATE AS date, count(*) AS n, sum(round(value * 100)) AS total FROM events GROUP BY ALL),
      a AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-02-04', INTERVAL 1 DAY))::DATE AS date)
      SELECT zone, date, coalesce(n, 0) AS n, total FROM (SELECT z.zone, a.date FROM (SELECT DISTINCT zone FROM r) z, a) FULL JOIN r USING (zone, date)""",
    "complete_months": f"""WITH r AS (SELECT o_custkey::VARCHAR AS zone, month(o_orderdate)::INT AS month, count(*) AS n, sum(round(o_totalprice * 100)) AS v
        FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED' GROUP BY ALL)
      SELECT zone, month, coalesce(n, 0) AS n_fires, coalesce(v, 0) AS fire_density
      FROM (SELECT z.zone, m.month FROM (SELECT DISTINCT zone FROM r) z, {_MONTHS}) LEFT JOIN r USING (zone, month)""",
    "daily_panel": _with(EVENT_DAILY, select=f"SELECT zone, date, {_DAY_COUNTS}, round(reading, 6) AS reading, above FROM ev_day"),
    "monthly_panel": _with(EVENT_WEEK, select=f"SELECT zone, week, {_DAY_COUNTS}, round(reading, 6) AS reading, days_above FROM ev_week"),
    "outcome_monthly_panel": _with(OUTCOME, select=f"""SELECT zone, month, {_ROLL}, round(avg(reading), 6) AS reading,
        CASE WHEN count(*) = count(above) THEN count(*) FILTER (above) END AS days_above
      FROM (SELECT coalesce(c.zone, r.zone) AS zone, month(coalesce(c.date, r.date))::INT AS month, {_ZERO}, reading, reading > 25000000 AS above
        FROM out_dense c FULL JOIN order_day r ON c.zone = r.zone AND c.date = r.date) GROUP BY zone, month"""),
    "monthly_mean": """SELECT o_custkey::VARCHAR AS zone, month(o_orderdate)::INT AS month, year(o_orderdate)::INT AS year,
        round(avg(round(o_totalprice * 100)), 6) AS reading_mean FROM orders GROUP BY ALL""",
    "length_of_stay": "", "length_of_stay_fatal": "",
    "last_in_period": _with(COUNTER, select="""SELECT zone, ((day(date) - 1) // 7)::INT AS week, CASE WHEN cases >= 1000 THEN cases END AS cases, deaths
      FROM counter QUALIFY row_number() OVER (PARTITION BY zone, (day(date) - 1) // 7 ORDER BY ts DESC, event_id DESC) = 1"""),
    "fill_down": _with(COUNTER, f"""n AS (SELECT zone, ((day(date) - 1) // 7)::INT AS week, cases, deaths FROM counter
        QUALIFY row_number() OVER (PARTITION BY zone, (day(date) - 1) // 7 ORDER BY ts DESC, event_id DESC) = 1)""", select=f"""
      SELECT zone, week, last_value(cases IGNORE NULLS) OVER (PARTITION BY zone ORDER BY week ROWS UNBOUNDED PRECEDING) AS cases,
        last_value(deaths IGNORE NULLS) OVER (PARTITION BY zone ORDER BY week ROWS UNBOUNDED PRECEDING) AS deaths
      FROM (SELECT z.zone, w.week FROM (SELECT DISTINCT zone FROM n) z, {_WEEKS}) LEFT JOIN n USING (zone, week)"""),
    "cumulative_to_increment": _with(INCREMENTS, select="SELECT zone, week::INT AS week, cases_total, deaths_total, cases_new, deaths_new FROM incr"),
    "clearing_monthly": _with(CENSUS, _cut("month", "month(o_orderdate)::INT", _MONTHS), select="SELECT zone, month, area FROM cut_area"),
    "accent_join": """SELECT p_partkey, translate(p_name, 'aeou', 'áéõü') AS name, p.p_type, n
      FROM part p JOIN (SELECT p_name AS other, p_type, count(*) AS n FROM part GROUP BY ALL) s
        ON strip_accents(translate(p_name, 'aeou', 'áéõü')) = other AND p.p_type = s.p_type""",
    "unpivot_months": f"""SELECT code, month, v AS precipitation
      FROM (SELECT z.code, m.month FROM (SELECT DISTINCT o_custkey::VARCHAR AS code FROM orders) z, {_MONTHS})
        LEFT JOIN (SELECT o_custkey::VARCHAR AS code, month(o_orderdate)::INT AS month, sum(round(o_totalprice * 100)) AS v FROM orders GROUP BY ALL)
        USING (code, month)""",
    "unpivot_stat_dates": """WITH r AS (SELECT user_id::VARCHAR AS zone, ts::DATE AS date, round(avg(round(value * 100)), 6) AS a, max(round(value * 100)) AS b FROM events GROUP BY ALL),
      g AS (SELECT zone, date FROM (SELECT DISTINCT zone FROM r), (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY))::DATE AS date))
      SELECT zone, 'mean' AS fun, date, a AS ppm25 FROM g LEFT JOIN r USING (zone, date)
      UNION ALL SELECT zone, 'max', date, b FROM g LEFT JOIN r USING (zone, date)""",
    "dim_census": _with(CENSUS, select=f"""SELECT zone, name, state, {_r('idhm')}, espvida, rdpc, gini, pop, size, zone IN {_CAPITALS} AS capital FROM census"""),
    "size_band": """SELECT c_custkey, pop, CASE WHEN pop < 2500 THEN 'p' WHEN pop < 5000 THEN 'm' ELSE 'g' END AS size
      FROM (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal)::BIGINT END AS pop FROM customer)""",
    "base_panel": _with(BASE, select=f"""SELECT * REPLACE (round(reading, 6) AS reading, round(idhm, 6) AS idhm) FROM base"""),
    "season_filter": "SELECT o_orderkey, month(o_orderdate)::INT AS month, o_totalprice FROM orders WHERE month(o_orderdate) BETWEEN 7 AND 10",
    "zone_profile": _with(PROFILE, select=f"SELECT zone, {_r(*PROFILE_COLUMNS)} FROM profile"),
    "grid_consolidate": _with(GRID, select="""SELECT event_id, cell_x, cell_y, 'ymd_' || strftime(date_utc, '%Y-%m-%d') || '_' ||
        strftime(band_ts - INTERVAL 5 HOURS, '%H:%M:%S') AS band, date_utc, date_local, round(value, 6) AS value FROM grid"""),
    "grid_daily_mean": _with(GRID, select="SELECT cell_x, cell_y, date, round(value, 6) AS value FROM grid_day"),
    "grid_daily_mean_latest_run": _with(GRID, select="""SELECT cell_x, cell_y, date_local AS date, round(avg(value), 6) AS value
      FROM (SELECT * FROM grid QUALIFY row_number() OVER (PARTITION BY cell_x, cell_y, band_ts ORDER BY run_ts DESC) = 1) GROUP BY ALL"""),
    "zone_cell_coverage": _with(COVER, select="SELECT polygon, cell_x, cell_y, round(cov, 6) AS cov FROM cover"),
    "polygon_stats": _with(STATS, select="SELECT polygon, date, fun, round(value, 6) AS value FROM stats"),
    "zonal_stats": _with(STATS, select="""SELECT zone, fun, date, round(avg(value), 6) AS value
      FROM stats JOIN (SELECT s_suppkey AS polygon, s_nationkey::VARCHAR AS zone FROM supplier) USING (polygon) GROUP BY zone, fun, date"""),
    "effect_lookup": _with(EVENT_WEEK, select="""SELECT model, round(d, 6) AS days_above, round(r, 6) AS reading, round(1 - exp(d), 6) AS decrease,
        round(exp(d) - 1, 6) AS increase
      FROM (SELECT 'admissions' AS model, regr_slope(ln(1 + admissions), days_above) AS d, regr_slope(ln(1 + admissions), reading) AS r FROM ev_week
        UNION ALL SELECT 'confirmed', regr_slope(ln(1 + confirmed), days_above), regr_slope(ln(1 + confirmed), reading) FROM ev_week)"""),
    "report_overall": _with(BASE, MONITORED, select=f"""SELECT scope, mean_days, {_pct('mean_days')}
      FROM (SELECT 'whole' AS scope, {_half_up('days_above')} AS mean_days FROM monitored WHERE {_STATES} AND state SIMILAR TO '.*[02468]'
        UNION ALL SELECT 'all', {_half_up('days_above')} FROM monitored WHERE {_STATES})"""),
    "report_states": _with(BASE, select=f"""SELECT state, mean_days, {_pct('mean_days')}, scope
      FROM (SELECT state, 'season' AS scope, {_half_up('days_above')} AS mean_days FROM season GROUP BY state
        UNION ALL SELECT state, 'last week', {_half_up('days_above')} FROM base WHERE week = 4 GROUP BY state)"""),
    "report_vulnerable": _with(BASE, select=f"""SELECT zone, days_above, name, state, {_pct('days_above')}
      FROM (SELECT zone, {_half_up('days_above')} AS days_above FROM season WHERE zone IN (FROM flagged) GROUP BY zone) JOIN (SELECT zone, name, state FROM census) USING (zone)"""),
    "report_zones": _with(BASE, select=f"""SELECT zone, days_above, name, state, {_pct('days_above', False)}
      FROM (SELECT zone, {_half_up('days_above')} AS days_above FROM season WHERE {_STATES} GROUP BY zone) JOIN (SELECT zone, name, state FROM census) USING (zone)"""),
    "semi_vulnerable": _with(BASE, select="SELECT zone, week, admissions, days_above, name, state FROM base WHERE zone IN (FROM flagged)"),
    "report_season": _with(BASE, select=_totals("season", _KEYS, ["admissions", "confirmed", "days_above"])),
    "report_grouped_by_measure": _with(BASE, select=_totals("season", _KEYS + ", admissions, confirmed", ["admissions", "confirmed", "days_above"])),
    "report_single_state_month": _with(BASE, select=_totals("(SELECT * FROM base WHERE state = 'NATION_4' AND week = 2)", _KEYS,
                                                            ["admissions", "confirmed", "days_above", "n_fires"])),
    "counterfactual": _with(BASE, select=f"""SELECT zone, name, state, pop, CASE WHEN pop < 25000 THEN 'p' WHEN pop < 100000 THEN 'm' ELSE 'g' END AS size, week,
        admissions, confirmed, days_above, round(exp({_A} * days_above), 6) AS ratio_admissions, round(exp({_B} * days_above), 6) AS ratio_confirmed,
        round(admissions / exp({_A} * days_above), 6) AS admissions_without, round(confirmed / exp({_B} * days_above), 6) AS confirmed_without FROM base"""),
    "source_reconciliation": _with(BASE, select=f"""SELECT state, week, ({_NULL_SUM.format('deaths_confirmed')})::BIGINT AS deaths_confirmed,
        ({_NULL_SUM.format('deaths_new')})::BIGINT AS deaths_new FROM base GROUP BY state, week"""),
    "log_histogram": """SELECT bin, n, round(pow(10.0::DOUBLE, bin / 5.0::DOUBLE), 6) AS lower
      FROM (SELECT floor(log10(o_totalprice) * 5)::BIGINT AS bin, count(*) AS n FROM orders WHERE o_totalprice > 0 GROUP BY 1)""",
    "standardize": _with(PROFILE, select="SELECT zone, " + ", ".join(
        f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) AS {c}" for c in PROFILE_COLUMNS) + " FROM profile"),
}

_DISC = """(SELECT l_suppkey AS zone, year(l_shipdate)::INT AS year, month(l_shipdate)::INT AS month, CASE WHEN l_discount > 0 THEN round(l_discount * 100) END AS x
  FROM lineitem)"""
ORACLE["na_propagating_agg"] = f"""SELECT zone, year, month, round({_NULL_MEAN.format('x')}, 6) AS mean_x, {_NULL_SUM.format('x')} AS sum_x
  FROM {_DISC} GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY zone, year, month")
ORACLE["na_skipping_agg"] = f"SELECT zone, year, month, round(avg(x), 6) AS mean_x, sum(x) AS sum_x FROM {_DISC} GROUP BY zone, year, month"

for _key, _died in (("length_of_stay", "NOT died"), ("length_of_stay_fatal", "died")):
    ORACLE[_key] = _with(OUTCOME, ORDER_COUNTER, select=f"""
      SELECT o_orderkey, s.zone, exposed, s.month, admitted, ended, stay, s.month BETWEEN 7 AND 10 AS in_season, round(r.reading, 6) AS reading,
        r.reading > 25000000 AS above, cases_total, cases_new
      FROM (SELECT *, month(exposed)::INT AS month, CASE WHEN ended = admitted THEN 0.01::DOUBLE ELSE (ended - admitted)::DOUBLE END AS stay
          FROM (SELECT *, coalesce(outcome, closed) AS ended FROM cases WHERE {_died})) s
        LEFT JOIN order_day r ON r.zone = s.zone AND r.date = s.exposed LEFT JOIN oc ON oc.zone = s.zone AND oc.month = s.month
      WHERE stay BETWEEN 0 AND 100""")

COUNT_ROWS = """
shipped AS (SELECT l_orderkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1)
--
yearly AS (SELECT o_custkey AS c_custkey, year(o_orderdate) AS year, sum(coalesce(quantity, 0)) AS y, count(*) AS orders, avg(o_totalprice) / 100000 AS price
  FROM orders LEFT JOIN shipped ON l_orderkey = o_orderkey GROUP BY 1, 2)
--
counted AS (SELECT c_custkey, year, y, price, c_mktsegment AS segment, 6.0::DOUBLE AS theta, ln(orders) + 4.5::DOUBLE + 0.01::DOUBLE * (c_acctbal / 1000)
    + 0.05::DOUBLE * price + CASE c_mktsegment WHEN 'BUILDING' THEN -0.1 WHEN 'FURNITURE' THEN 0.05 WHEN 'HOUSEHOLD' THEN 0.02 WHEN 'MACHINERY' THEN -0.03 ELSE 0 END::DOUBLE AS eta
  FROM yearly JOIN customer USING (c_custkey))
"""
_NB = "lgamma(y + theta) - lgamma(theta) - lgamma(y + 1) + theta * ln(theta) + y * e - (y + theta) * ln(theta + exp(e))"

ORACLE["residual_check_given"] = _with(COUNT_ROWS, select="""SELECT segment, count(*) AS n, round(avg(r), 4) AS mean_residual, round(avg(r * r), 4) AS dispersion,
    count(*) FILTER (y = 0) AS zeros_observed, round(sum(pow(theta / (theta + exp(eta)), theta)), 4) AS zeros_expected
  FROM (SELECT *, (y - exp(eta)) / sqrt(exp(eta) + exp(eta) * exp(eta) / theta) AS r FROM counted) GROUP BY segment""")


def _level_likelihood(rows: str, log_f: str) -> str:
    return _with(COUNT_ROWS, select=f"""SELECT segment, count(*) AS customers, sum(n)::BIGINT AS rows, round(sum(log_lik), 2) AS log_lik
  FROM (SELECT segment, c_custkey, max(n) AS n, max(t) + ln(sum(exp(t - top)) * 0.01::DOUBLE / sqrt(2 * pi())) AS log_lik
    FROM (SELECT *, max(t) OVER (PARTITION BY c_custkey) AS top
      FROM (SELECT segment, c_custkey, u, count(*) AS n, sum({log_f}) - u * u / 2 AS t
        FROM (SELECT *, {_NB} AS lf FROM (SELECT *, eta + 0.3::DOUBLE * u AS e FROM {rows}, (SELECT unnest(generate_series(-600, 600)) / 100.0::DOUBLE AS u))) GROUP BY segment, c_custkey, u))
    GROUP BY segment, c_custkey) GROUP BY segment""")


ORACLE["nb_level_likelihood"] = _level_likelihood("counted", "lf")
ORACLE["nb_zero_inflated_likelihood"] = _level_likelihood(
    "(SELECT c_custkey, segment, theta, eta, CASE WHEN price > 2.5 THEN 0.0 ELSE y END::DOUBLE AS y FROM counted)",
    "CASE WHEN y = 0 THEN ln(0.1::DOUBLE + 0.9::DOUBLE * exp(lf)) ELSE ln(0.9::DOUBLE) + lf END")
ORACLE["residual_histogram"] = _with(COUNT_ROWS, select=f"""SELECT segment, bin::INT AS bin, count(*) AS n,
    round(avg((greatest(low, least(high, bin / 10.0::DOUBLE)) - greatest(low, least(high, (bin - 1) / 10.0::DOUBLE))) / (high - low)), 5) AS share
  FROM (SELECT segment, sum(f) FILTER (i <= y) AS high, coalesce(sum(f) FILTER (i < y), 0) AS low
    FROM (SELECT c_custkey, year, segment, y0 AS y, y AS i, exp({_NB}) AS f
      FROM (SELECT c_custkey, year, segment, theta, eta AS e, y AS y0, unnest(generate_series(0, y::BIGINT))::DOUBLE AS y FROM counted)) GROUP BY c_custkey, year, segment),
    (SELECT unnest(generate_series(1, 10)) AS bin) GROUP BY segment, bin""")
_CENTERS = ((0.5, 0.25, 0.5, 0.25, 0.5, 0.0, 0.5), (-0.5, -0.25, -0.5, -0.25, -0.5, 0.0, -0.5), (0.0, 1.0, 0.0, 0.0, 1.0, 1.5, 0.0))
ORACLE["kmeans_one_pass"] = _with(PROFILE, select=f"""SELECT cluster, count(*) AS n, round(sum(d), 6) AS cost, {', '.join(f'round(avg({c}), 6) AS {c}' for c in PROFILE_COLUMNS)}
  FROM (SELECT *, least(d1, d2, d3) AS d, CASE WHEN d1 <= d2 AND d1 <= d3 THEN 1 WHEN d2 <= d3 THEN 2 ELSE 3 END AS cluster
    FROM (SELECT *, {', '.join(' + '.join(f'pow({c} - ({m}), 2)' for c, m in zip(PROFILE_COLUMNS, center)) + f' AS d{i}' for i, center in enumerate(_CENTERS, 1))}
      FROM (SELECT {', '.join(f'({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}' for c in PROFILE_COLUMNS)} FROM profile)
      WHERE {' AND '.join(f'{c} IS NOT NULL' for c in PROFILE_COLUMNS)})) GROUP BY cluster""")

_WARNED = ("admissions", "reading", "days_above")
ORACLE["report_warned"] = _with(BASE, f"""
last_profile AS (SELECT zone, {', '.join(f'{_NULL_MEAN.format(c)} AS {c}' for c in _WARNED)} FROM base WHERE week = 4 AND reading IS NOT NULL GROUP BY zone)
--
last_scaled AS (SELECT zone, {', '.join(f'({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}' for c in _WARNED)} FROM last_profile)
--
warned AS (SELECT zone FROM (SELECT *, {', '.join(' + '.join(f'pow({c} - ({m}), 2)' for c, m in zip(_WARNED, center)) + f' AS d{i}'
    for i, center in enumerate(((1.0, 0.5, 1.0), (0.0, 0.0, 0.0), (-1.0, -0.5, -1.0)), 1))} FROM last_scaled) WHERE d1 <= d2 AND d1 <= d3)
""", select=f"""SELECT zone, days_above, name, state, {_pct('days_above', False)}
  FROM (SELECT zone, {_half_up('days_above')} AS days_above FROM base WHERE week = 4 AND zone IN (FROM warned) GROUP BY zone) JOIN (SELECT zone, name, state FROM census) USING (zone)""")
