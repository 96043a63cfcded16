"""DuckDB definitions of the fixture views (FIXTURES.md §2), used to build the
independent oracle SQL for every registered query.

``with_views(body, names)`` prepends the needed CTEs in dependency order.
Literals are written as doubles on purpose: bare decimals are DECIMAL in
DuckDB.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[list[str], str]] = {
    "requests_short": ([], """
    SELECT CAST(event_id AS VARCHAR) AS case_id,
           ts AS opened,
           CASE WHEN event_id % 10 = 0 THEN NULL
                ELSE ts + to_seconds(CAST(round(value * 3600) AS BIGINT)) END AS closed,
           event_type AS category,
           CAST(NULL AS VARCHAR) AS status,
           CAST(CASE WHEN user_id % 13 = 0 THEN NULL ELSE user_id % 11 + 1 END AS INTEGER) AS district,
           37.4::DOUBLE + ((event_id * 7919) % 7000) / 10000.0::DOUBLE AS latitude,
           -123.1::DOUBLE + ((event_id * 104729) % 12000) / 10000.0::DOUBLE AS longitude,
           CAST(NULL AS VARCHAR) AS address
    FROM events"""),
    "rs": (["requests_short"], """
    SELECT *, date_diff('microsecond', opened, closed) / 3.6e9 AS resolution_hours,
           date_diff('microsecond', opened, closed) AS res_us FROM requests_short"""),
    "portal": ([], """
    SELECT CAST(event_id AS VARCHAR) AS service_request_id,
           strftime(ts, '%Y-%m-%d %H:%M:%S') AS requested_datetime,
           CASE WHEN event_id % 10 = 0 THEN NULL
                ELSE strftime(ts + to_seconds(CAST(round(value * 3600) AS BIGINT)), '%Y-%m-%d %H:%M:%S') END
             AS closed_date,
           CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_type END AS service_name,
           CASE WHEN event_id % 10 = 0 THEN 'Open' ELSE 'Closed' END AS status_description,
           CAST(event_id % 1000 AS VARCHAR) || ' Main St' AS address,
           CASE WHEN user_id % 13 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 'abc'
                ELSE CAST(user_id % 11 + 1 AS VARCHAR) END AS supervisor_district,
           CASE WHEN event_id % 23 = 0 THEN NULL
                ELSE 37.4::DOUBLE + ((event_id * 7919) % 7000) / 10000.0::DOUBLE END AS p_lat,
           CASE WHEN event_id % 23 = 0 THEN NULL
                ELSE -123.1::DOUBLE + ((event_id * 104729) % 12000) / 10000.0::DOUBLE END AS p_lon
    FROM events"""),
    "portal_clean": (["portal"], """
    SELECT service_request_id, status_description, address,
           CAST(requested_datetime AS TIMESTAMP) AS opened, TRY_CAST(closed_date AS TIMESTAMP) AS closed,
           coalesce(service_name, 'Unknown') AS category,
           CAST(TRY_CAST(supervisor_district AS DOUBLE) AS INTEGER) AS district,
           p_lat AS latitude, p_lon AS longitude,
           date_diff('microsecond', CAST(requested_datetime AS TIMESTAMP), TRY_CAST(closed_date AS TIMESTAMP)) / 3.6e9
             AS resolution_hours
    FROM portal"""),
    "first_ship": ([], "SELECT l_orderkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY l_orderkey"),
    "requests_long": (["first_ship"], """
    SELECT CAST(o_orderkey AS VARCHAR) AS case_id,
           o_orderdate AS opened,
           fs.first_ship AS closed,
           o_orderpriority AS category,
           o_orderstatus AS status,
           CAST(CASE WHEN c_nationkey = 0 THEN NULL ELSE c_nationkey END AS INTEGER) AS district,
           CAST(NULL AS DOUBLE) AS latitude,
           CAST(NULL AS DOUBLE) AS longitude,
           CAST(NULL AS VARCHAR) AS address
    FROM orders o
    LEFT JOIN first_ship fs ON o.o_orderkey = fs.l_orderkey
    LEFT JOIN customer c ON o.o_custkey = c.c_custkey"""),
    "rl": (["requests_long"], """
    SELECT *, date_diff('microsecond', opened, closed) / 3.6e9 AS resolution_hours,
           date_diff('microsecond', opened, closed) AS res_us FROM requests_long"""),
    "ev_src": ([], """
    SELECT CAST(date_trunc('week', l_shipdate) AS DATE) + 5 AS event_date, p_name AS name, l_orderkey, l_linenumber, l_partkey
    FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE l_returnflag = 'R'"""),
    "cl_src": ([], """
    SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS closure_date, p_name AS name, p_type AS street,
           l_orderkey, l_linenumber, l_partkey
    FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE l_returnflag = 'A'"""),
    "pm_src": ([], """
    SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, 'construction' AS event_type, left(p_brand, 80) AS name,
           l_orderkey, l_linenumber, l_partkey
    FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE l_returnflag = 'N'"""),
    "crime": ([], """
    SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey % 11 + 1 AS INTEGER) AS district FROM lineitem"""),
    "crime_agg": (["crime"], "SELECT date, district, count(*) AS count FROM crime GROUP BY date, district"),
    "weather": ([], """
    SELECT date,
           12.0::DOUBLE + ((dn * 13) % 11) / 2.0::DOUBLE AS temp_max_c,
           6.0::DOUBLE + ((dn * 7) % 9) / 2.0::DOUBLE AS temp_min_c,
           ((dn * 37) % 10) / 20.0::DOUBLE AS precip_mm,
           CASE WHEN ((dn * 37) % 10) / 20.0::DOUBLE > 0.1::DOUBLE THEN 1 ELSE 0 END AS rain_day
    FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date,
                 date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS dn FROM orders)"""),
    "districts": ([], """
    SELECT * FROM (VALUES (1, 'Richmond'), (2, 'Marina, Cow Hollow'), (3, 'North Beach, Chinatown'),
        (4, 'Sunset'), (5, 'Haight-Ashbury, Fillmore'), (6, 'SOMA, Tenderloin'),
        (7, 'Mission, Bernal Heights'), (8, 'Castro, Noe Valley'), (9, 'Mission, Portola'),
        (10, 'Potrero Hill, Bayview'), (11, 'Excelsior, Outer Mission')) AS t(district, name)"""),
    "events_agg": (["ev_src", "cl_src", "pm_src"], """
    SELECT date,
           CAST(sum(CASE WHEN src = 0 THEN 1 ELSE 0 END) AS BIGINT) AS event_count,
           CAST(sum(CASE WHEN src = 1 THEN 1 ELSE 0 END) AS BIGINT) AS street_closure_count,
           CAST(sum(CASE WHEN src = 2 THEN 1 ELSE 0 END) AS BIGINT) AS construction_count
    FROM (SELECT event_date AS date, 0 AS src FROM ev_src
          UNION ALL SELECT closure_date, 1 FROM cl_src
          UNION ALL SELECT date, 2 FROM pm_src) t
    WHERE date IS NOT NULL GROUP BY date"""),
    "name_cand": (["ev_src", "cl_src", "pm_src"], """
    SELECT date,
           CASE WHEN length(name) > 80 THEN left(name, 80) || '…' ELSE name END AS name,
           src, l_orderkey, l_linenumber, l_partkey
    FROM (
      SELECT event_date AS date, trim(coalesce(name, '')) AS name, 0 AS src, l_orderkey, l_linenumber, l_partkey
      FROM ev_src WHERE event_date IS NOT NULL
        AND trim(coalesce(name, '')) <> '' AND length(trim(coalesce(name, ''))) < 120
      UNION ALL
      SELECT closure_date, n, 1, l_orderkey, l_linenumber, l_partkey FROM (
        SELECT closure_date, l_orderkey, l_linenumber, l_partkey,
               CASE WHEN street IS NULL THEN trim(coalesce(name, ''))
                    WHEN trim(coalesce(name, '')) <> '' THEN trim(trim(coalesce(name, '')) || ' (' || street || ')')
                    ELSE street END AS n
        FROM cl_src WHERE closure_date IS NOT NULL) c
      WHERE n <> '' AND length(n) < 100
      UNION ALL
      SELECT date, left('Construction: ' || trim(name), 80), 2, l_orderkey, l_linenumber, l_partkey
      FROM pm_src WHERE date IS NOT NULL AND name IS NOT NULL
    ) u"""),
    "events_by_date": (["name_cand"], """
    SELECT date, string_agg(name, '|' ORDER BY rn) AS event_names FROM (
      SELECT date, name, row_number() OVER (PARTITION BY date ORDER BY o) AS rn
      FROM (SELECT date, name, min({'s': src, 'k': l_orderkey, 'l': l_linenumber, 'p': l_partkey}) AS o
            FROM name_cand GROUP BY date, name) d
    ) t WHERE rn <= 8 GROUP BY date"""),
}


def _order(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_views(body: str, *names: str, extra: str | None = None) -> str:
    """``WITH <views in dependency order>[, <extra CTEs>] <body>``."""
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in _order(list(names)))
    if extra:
        ctes = f"{ctes},\n{extra.strip()}"
    return f"WITH {ctes}\n{body}"
