"""DuckDB SQL that gives the same rows as the queries in problems.py, where SQL can say it."""

from __future__ import annotations

_NO_VALUE = (
    "coalesce(list_contains(['', 'unknown', 'unk', 'not available', 'n/a', 'na', 'none', 'null', 'nil', 'nan', 'missing', 'not known', 'undefined', 'blank', 'no value', 'not recorded', "
    "'neighborhood unknown', 'neighborhood not available'], lower(trim(regexp_replace({c}, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')))), true)"
)

_TRIPS = """
trips AS (
  SELECT upper(trim(hack_license)) AS h, upper(trim(medallion)) AS m, epoch(pickup_datetime)::BIGINT AS s,
         max(greatest(epoch(pickup_datetime)::BIGINT, coalesce(epoch(dropoff_datetime)::BIGINT, epoch(pickup_datetime)::BIGINT))) AS e
  FROM example WHERE trim(hack_license) <> '' AND pickup_datetime IS NOT NULL GROUP BY ALL),
latest AS (SELECT *, max(e) OVER (PARTITION BY h ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM trips)"""

_IDS = """
ids AS (
  SELECT load_id, pickup_day_of_month AS day, nullif(lower(trim(pickup_borough)), '') AS borough, 'medallion' AS id_kind, nullif(upper(trim(medallion)), '') AS id FROM example
  UNION ALL
  SELECT load_id, pickup_day_of_month, nullif(lower(trim(pickup_borough)), ''), 'hack_license', nullif(upper(trim(hack_license)), '') FROM example),
bits AS (SELECT *, ('0x' || substr(md5(id), 1, 12))::BIGINT % 65536 AS bit FROM ids WHERE id IS NOT NULL)"""

_COUNTED = """count(DISTINCT bit) AS bits_set, round(-65536.0 * ln((65536.0 - count(DISTINCT bit)) / 65536.0))::BIGINT AS estimate,
  round((4 * sqrt(greatest(65536.0 * (exp(-ln((65536.0 - count(DISTINCT bit)) / 65536.0)) + ln((65536.0 - count(DISTINCT bit)) / 65536.0) - 1), 0.0)) + 2) / (-65536.0 * ln((65536.0 - count(DISTINCT bit)) / 65536.0)), 6) AS error_bound"""

_WORDS = ", ".join(
    f"coalesce(bit_or(CASE WHEN bit % 512 // 64 = {i} THEN CASE WHEN bit % 64 = 63 THEN -9223372036854775807 - 1 ELSE 1::BIGINT << (bit % 64)::INT END END), 0) AS w{i}" for i in range(8)
)


def oracle_sql() -> dict[str, str]:
    amounts = " UNION ALL ".join(
        f"SELECT nullif(lower(trim(pickup_neighborhood)), '') AS pickup_neighborhood, '{c}' AS field_name, {c}::DOUBLE AS v FROM example" for c in ("fare_amount", "trip_distance", "tip_amount")
    )
    return {
        "p2_found": f"""
SELECT 'example' AS tbl, trip_id AS row_id, 'tip_amount' AS field_name FROM example WHERE tip_amount IS NULL OR isnan(tip_amount) OR tip_amount IN (-1, -9, -99, -999, 999, 999.99, 9999, 9999.99, 99999, 99999.99)
UNION ALL SELECT 'example', trip_id, 'payment_type' FROM example WHERE {_NO_VALUE.format(c="payment_type")}
UNION ALL SELECT 'taxi', row_id, 'dropoff_neighborhood' FROM taxi WHERE {_NO_VALUE.format(c="dropoff_neighborhood")}""",
        "p3_found": f"""
WITH {_TRIPS}, numbered AS (SELECT *, sum((pe IS NULL OR s > pe + 2700)::INT) OVER (PARTITION BY h ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM latest)
SELECT h AS hack_license, min(s) AS session_start, max(e) AS session_end, count(*) AS trips FROM numbered GROUP BY h, k""",
        "p3_gap_settings": f"""
WITH {_TRIPS}, settings AS (SELECT unnest([900, 2700, 7200, 28800])::INT AS gap_setting_s),
numbered AS (SELECT *, sum((pe IS NULL OR s > pe + gap_setting_s)::INT) OVER (PARTITION BY h, gap_setting_s ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM latest, settings),
sess AS (SELECT h, gap_setting_s, max(e) - min(s) AS d, count(*) AS n FROM numbered GROUP BY h, gap_setting_s, k)
SELECT h AS hack_license, gap_setting_s, count(*) AS sessions, sum(n)::BIGINT AS trips, max(d) AS longest_s FROM sess GROUP BY 1, 2""",
        "p6_bounds": " UNION ALL ".join(
            f"SELECT load_id, '{c}' AS field_name, count(*) AS n, count(*) - count({c}) AS nulls, min({c})::VARCHAR AS low, max({c})::VARCHAR AS high FROM example GROUP BY load_id"
            for c in ("passenger_count", "rate_code", "store_and_fwd_flag", "payment_type")
        ),
        "p5_load_bitmaps": f"""WITH {_IDS}
SELECT load_id, 'day_borough' AS grouping_level, day, borough, id_kind, 65536 AS bits, bit // 512 AS page, {_WORDS} FROM bits GROUP BY load_id, day, borough, id_kind, bit // 512
UNION ALL SELECT load_id, 'day', day, NULL, id_kind, 65536, bit // 512, {_WORDS} FROM bits GROUP BY load_id, day, id_kind, bit // 512
UNION ALL SELECT load_id, 'borough', NULL, borough, id_kind, 65536, bit // 512, {_WORDS} FROM bits GROUP BY load_id, borough, id_kind, bit // 512""",
        "p5_within_bound": f"""WITH {_IDS}
SELECT 'day_borough' AS grouping_level, day, borough, id_kind, count(DISTINCT id) AS ids, true AS within_bound FROM bits GROUP BY day, borough, id_kind
UNION ALL SELECT 'day', day, NULL, id_kind, count(DISTINCT id), true FROM bits GROUP BY day, id_kind
UNION ALL SELECT 'borough', NULL, borough, id_kind, count(DISTINCT id), true FROM bits GROUP BY borough, id_kind""",
        "p5_load_counts": f"WITH {_IDS} SELECT load_id, day, borough, id_kind, {_COUNTED} FROM bits GROUP BY 1, 2, 3, 4",
        "p5_distinct": f"""WITH {_IDS}
SELECT 'day_borough' AS grouping_level, day, borough, id_kind, {_COUNTED} FROM bits GROUP BY day, borough, id_kind
UNION ALL SELECT 'day', day, NULL, id_kind, {_COUNTED} FROM bits GROUP BY day, id_kind
UNION ALL SELECT 'borough', NULL, borough, id_kind, {_COUNTED} FROM bits GROUP BY borough, id_kind""",
        "p4_within_bound": f"""
WITH v AS ({amounts}), g AS (SELECT pickup_neighborhood, field_name, count(*) AS n FROM v WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v) GROUP BY 1, 2)
SELECT pickup_neighborhood, field_name, p, n, true AS within_bound FROM g, (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]::DOUBLE[]) AS p)""",
    }
