"""DuckDB SQL with the same results as the registered queries."""

LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
LINE_DESC = ", ".join(f"{c} DESC" for c in LINE.split(", "))
SERIES = ["A_F", "A_O", "N_F", "N_O", "R_F", "R_O"]
KEY = "series_id, source, date, release_date_key"

CTES = {
    "obs": """
        SELECT l_returnflag || '_' || l_linestatus AS series_id,
               CASE WHEN l_linenumber % 2 = 0 THEN 'bls' ELSE 'fred' END AS source,
               CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
               CASE WHEN l_partkey % 97 <> 0 THEN l_extendedprice END AS value,
               CASE WHEN l_orderkey % 53 <> 0
                    THEN CAST(l_shipdate AS DATE) + CAST(l_orderkey % 40 AS INTEGER) END AS release_date,
               TIMESTAMP '2026-01-01 00:00:00' AS fetched_at,
               l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
        FROM lineitem""",
    "idx": """
        SELECT o_orderpriority AS series_id, 'bls' AS source, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
               CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS value,
               last_day(CAST(date_trunc('month', o_orderdate) AS DATE))
                 + CAST(10 + month(CAST(date_trunc('month', o_orderdate) AS DATE)) % 5 AS INTEGER) AS release_date
        FROM orders GROUP BY o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE)""",
    "daily": """
        SELECT event_type AS series_id, CAST(ts AS DATE) AS date,
               CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS value
        FROM events GROUP BY event_type, CAST(ts AS DATE)""",
    "cal": """
        SELECT DISTINCT 'Index' AS release_name, strftime(date, '%Y-%m') AS reference_period,
               last_day(date) + 12 AS release_date, '08:30' AS release_time
        FROM idx WHERE (year(date) * 12 + month(date)) % 7 <> 0""",
    "targets": """
        SELECT * FROM (
          SELECT 'mom_' || series_id AS target_id, series_id AS target_name, series_id, source, date AS reference_date,
                 release_date, 100 * (value / lag(value) OVER (PARTITION BY series_id ORDER BY date, release_date) - 1) AS target_value,
                 'percent' AS target_units
          FROM idx) WHERE target_value IS NOT NULL""",
    "shell": """
        SELECT CAST(release_date AS TIMESTAMP) AS forecast_timestamp, target_id, reference_date AS target_reference_date,
               release_date AS target_release_date, target_value
        FROM targets""",
    "cand": f"""
        SELECT series_id, release_date, date, source, value FROM obs WHERE release_date IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY series_id, release_date
                                   ORDER BY date DESC, source DESC, {LINE_DESC}) = 1""",
    "cells": """
        SELECT k.*, c.value FROM (SELECT shell.*, n.sid FROM shell, (SELECT DISTINCT series_id AS sid FROM obs) n) k
        ASOF LEFT JOIN cand c ON k.sid = c.series_id AND k.target_release_date >= c.release_date""",
    "asof_matrix": "SELECT forecast_timestamp, target_id, target_reference_date, target_release_date, target_value, "
    + ", ".join(f"max(CASE WHEN sid = '{s}' THEN value END) AS \"feature_{s}_latest\"" for s in SERIES)
    + " FROM cells GROUP BY ALL",
    "ds": """
        SELECT *, "feature_A_F_latest" AS x, target_value AS y,
               row_number() OVER (PARTITION BY target_id ORDER BY forecast_timestamp, target_reference_date) AS rn,
               row_number() OVER (ORDER BY forecast_timestamp, target_id, target_reference_date) AS prn
        FROM asof_matrix""",
    "naive": """
        SELECT * FROM (
          SELECT forecast_timestamp, target_id, target_reference_date, target_release_date, y AS actual,
                 lag(y) OVER (PARTITION BY target_id ORDER BY rn) AS prediction,
                 'naive_last_value' AS model_name, rn - 24 AS fold_number
          FROM ds) WHERE fold_number >= 1""",
    "ridge": """
        SELECT forecast_timestamp, target_id, target_reference_date, target_release_date, actual,
               CASE WHEN v = 0 THEN yb ELSE yb + n / (n + 1.0) * c / v * (xt - zb) END AS prediction,
               'ridge' AS model_name, rn - 24 AS fold_number
        FROM (
          SELECT forecast_timestamp, target_id, target_reference_date, target_release_date, rn, any_value(yt) AS actual,
                 count(*) AS n, avg(yr) AS yb, avg(z) AS zb, covar_pop(z, yr) AS c, var_pop(z) AS v,
                 any_value(coalesce(xt, m)) AS xt
          FROM (
            SELECT *, coalesce(xr, m) AS z FROM (
              SELECT f.forecast_timestamp, f.target_id, f.target_reference_date, f.target_release_date, f.rn,
                     f.x AS xt, f.y AS yt, t.x AS xr, t.y AS yr,
                     median(t.x) OVER (PARTITION BY f.target_id, f.rn) AS m
              FROM ds f JOIN ds t ON f.target_id = t.target_id AND t.rn < f.rn WHERE f.rn > 24))
          GROUP BY ALL)""",
    "fc": "SELECT * FROM naive UNION ALL SELECT * FROM ridge",
    "levels": """
        SELECT model_name, avg(abs(actual - prediction)) AS mae, sqrt(avg((actual - prediction) ** 2)) AS rmse,
               avg(CASE WHEN sign(actual) = sign(prediction) THEN 1.0 ELSE 0.0 END) AS level_direction
        FROM fc GROUP BY model_name""",
    "moves": """
        SELECT model_name, forecast_timestamp, target_id, target_reference_date, actual, prediction,
               sign(actual - lag(actual) OVER w) = sign(prediction - lag(prediction) OVER w) AS same_direction
        FROM fc WINDOW w AS (PARTITION BY model_name ORDER BY forecast_timestamp, target_id, target_reference_date)""",
    "scores": """
        SELECT model_name, sqrt(avg((actual - prediction) ** 2)) AS rmse, avg(abs(actual - prediction)) AS mae,
               avg(CAST(same_direction AS DOUBLE)) AS directional_accuracy, count(*) AS n_forecasts
        FROM moves GROUP BY model_name""",
    "metrics": """
        SELECT s.model_name, s.n_forecasts, s.rmse, s.mae, s.directional_accuracy,
               CASE WHEN s.model_name = 'naive_last_value' THEN 0.0 ELSE CAST(s.rmse < n.rmse AS DOUBLE) END AS beats_naive_rmse,
               CASE WHEN s.model_name = 'naive_last_value' THEN 0.0 ELSE CAST(s.mae < n.mae AS DOUBLE) END AS beats_naive_mae,
               CASE WHEN s.model_name = 'naive_last_value' THEN 0.0 ELSE n.rmse - s.rmse END AS rmse_vs_naive,
               CASE WHEN s.model_name = 'naive_last_value' THEN 0.0 ELSE n.mae - s.mae END AS mae_vs_naive
        FROM scores s, scores n WHERE n.model_name = 'naive_last_value'""",
    "base": f"""
        SELECT *, coalesce(strftime(release_date, '%Y-%m-%d'), '__MISSING__') AS release_date_key FROM obs""",
    "stored": f"""
        SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY {LINE_DESC}) = 1""",
    "batch": f"""
        SELECT series_id, source,
               CASE WHEN l_suppkey % 7 = 0 THEN CAST(date + INTERVAL 120 MONTH AS DATE) ELSE date END AS date,
               CASE WHEN l_suppkey % 5 = 0 THEN value + 1.0 ELSE value END AS value, release_date, release_date_key,
               CASE WHEN l_suppkey % 3 = 0 THEN fetched_at + INTERVAL 1 DAY ELSE fetched_at END AS fetched_at, {LINE}
        FROM base""",
    "changes": f"""
        SELECT {LINE}, CASE WHEN n = 1 THEN 'inserted'
                            WHEN value IS NOT DISTINCT FROM pv AND fetched_at IS NOT DISTINCT FROM pf THEN 'skipped'
                            ELSE 'updated' END AS action
        FROM (SELECT *, row_number() OVER w AS n, lag(value) OVER w AS pv, lag(fetched_at) OVER w AS pf
              FROM (SELECT {KEY}, value, fetched_at, {LINE}, 1 AS is_new FROM batch
                    UNION ALL SELECT {KEY}, value, fetched_at, {LINE}, 0 AS is_new FROM stored)
              WINDOW w AS (PARTITION BY {KEY} ORDER BY is_new, {LINE}))
        WHERE is_new = 1""",
}

# What each common table reads.
NEEDS = {
    "cal": ["idx"],
    "targets": ["idx"],
    "shell": ["targets"],
    "cand": ["obs"],
    "cells": ["shell", "cand", "obs"],
    "asof_matrix": ["cells"],
    "ds": ["asof_matrix"],
    "naive": ["ds"],
    "ridge": ["ds"],
    "fc": ["naive", "ridge"],
    "levels": ["fc"],
    "moves": ["fc"],
    "scores": ["moves"],
    "metrics": ["scores"],
    "base": ["obs"],
    "stored": ["base"],
    "batch": ["base"],
    "changes": ["batch", "stored"],
}


def _stump(cuts: str, columns: str, tested: str) -> str:
    """Boosting with one tree of two leaves on feature x, one model per cutoff of ``cuts``.

    Edges are values at set ranks of the rows before the cutoff at which training rows last doubled.
    """
    return f"""
        SELECT * FROM (
        WITH RECURSIVE cuts AS ({cuts}),
        ep AS (SELECT min(c) AS c, min(nb) AS nb FROM cuts UNION ALL
          SELECT (SELECT min(c) FROM cuts WHERE cuts.nb >= 2 * ep.nb), (SELECT min(nb) FROM cuts WHERE cuts.nb >= 2 * ep.nb)
          FROM ep WHERE EXISTS (SELECT 1 FROM cuts WHERE cuts.nb >= 2 * ep.nb)),
        edges AS (SELECT DISTINCT e, v FROM (
            SELECT ep.c AS e, d.x AS v, row_number() OVER (PARTITION BY ep.c ORDER BY d.x) - 1 AS r, count(*) OVER (PARTITION BY ep.c) AS n
            FROM ep JOIN ds d ON d.forecast_timestamp < ep.c AND d.x IS NOT NULL)
          WHERE ((r * 255 + n - 1) // n) * n // 255 = r AND (r * 255 + n - 1) // n < 255),
        own AS (SELECT cuts.c, max(ep.c) AS e FROM cuts JOIN ep ON ep.c <= cuts.c GROUP BY cuts.c),
        tr AS (SELECT own.c, own.e, d.y - avg(d.y) OVER w AS g, avg(d.y) OVER w AS base, median(d.x) OVER w AS med, d.x
          FROM own JOIN ds d ON d.forecast_timestamp < own.c WINDOW w AS (PARTITION BY own.c)),
        cand AS (SELECT tr.c, ed.v, count(*) AS n, count(*) FILTER (coalesce(x, med) < v) AS nl, sum(g) AS s,
            coalesce(sum(g) FILTER (coalesce(x, med) < v), 0) AS sl FROM tr JOIN edges ed ON ed.e = tr.e GROUP BY tr.c, ed.v),
        best AS (SELECT *, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n AS gain FROM cand WHERE nl >= 5 AND n - nl >= 5
          QUALIFY row_number() OVER (PARTITION BY c ORDER BY gain DESC, v) = 1),
        m AS (SELECT DISTINCT tr.c, base, med, v, n, nl, s, sl FROM tr LEFT JOIN best ON best.c = tr.c AND gain > 0),
        scored AS (SELECT f.*, base + coalesce(0.05 * CASE WHEN coalesce(x, med, '-infinity'::DOUBLE) < v THEN sl / nl ELSE (s - sl) / (n - nl) END, 0) AS p
          FROM ds f JOIN m ON {tested})
        {columns} FROM scored)"""


def _with(select: str, *names: str) -> str:
    order: list[str] = []

    def add(name):
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    tables = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name]})" for name in order)
    return f"WITH {tables}\n{select}"


KEYS3 = "forecast_timestamp, target_id, target_reference_date"
KEYS4 = f"{KEYS3}, target_release_date"
BASE5 = f"{KEYS4}, target_value"
OBS6 = "series_id, date, value, source, release_date, fetched_at"

_MOMENTS = " UNION ALL ".join(
    f"""SELECT f.forecast_timestamp, f.target_id, f.target_reference_date, f.rn - 24 AS fold_number,
               '{c}' AS column_name, count(t."{c}") AS train_count, round(avg(t."{c}"), 6) AS train_mean,
               round(stddev_pop(t."{c}"), 6) AS train_std, round(median(t."{c}"), 6) AS train_median
        FROM ds f JOIN ds t ON f.target_id = t.target_id AND t.rn < f.rn WHERE f.rn > 24 GROUP BY ALL"""
    for c in ("feature_A_F_latest", "feature_N_O_latest")
)
_USABLE = ", ".join(
    f"CASE WHEN count(\"feature_{s}_latest\") OVER w > 0 THEN 'feature_{s}_latest' END" for s in SERIES
)
_MISSING = " UNION ALL ".join(
    f"""SELECT 'feature_{s}_latest' AS feature_name, count(*) - count("feature_{s}_latest") AS missing_count,
               round((count(*) - count("feature_{s}_latest")) / count(*) * 100.0, 6) AS missing_pct,
               min(CASE WHEN "feature_{s}_latest" IS NOT NULL THEN forecast_timestamp END) AS first_valid_timestamp,
               max(CASE WHEN "feature_{s}_latest" IS NOT NULL THEN forecast_timestamp END) AS last_valid_timestamp,
               count("feature_{s}_latest") = 0 AS all_missing FROM asof_matrix"""
    for s in SERIES
)
# Two standardized features: a two-by-two ridge system solved by Cramer's rule.
_RIDGE_TWO = f"""
    SELECT {KEYS4}, actual,
           round(yb + ((n + 1) * b1 - n * r * b2) / det * coalesce((t1 - z1b) / nullif(s1, 0), 0)
                    + ((n + 1) * b2 - n * r * b1) / det * coalesce((t2 - z2b) / nullif(s2, 0), 0), 6) AS prediction,
           'ridge' AS model_name, rn - 24 AS fold_number
    FROM (
      SELECT *, coalesce(n * c1 / nullif(s1, 0), 0) AS b1, coalesce(n * c2 / nullif(s2, 0), 0) AS b2,
             (n + 1) * (n + 1) - n * n * r * r AS det
      FROM (
        SELECT {KEYS4}, rn, any_value(yt) AS actual, CAST(count(*) AS DOUBLE) AS n, avg(yr) AS yb,
               avg(z1) AS z1b, avg(z2) AS z2b, covar_pop(z1, yr) AS c1, covar_pop(z2, yr) AS c2,
               stddev_pop(z1) AS s1, stddev_pop(z2) AS s2,
               coalesce(covar_pop(z1, z2) / nullif(stddev_pop(z1) * stddev_pop(z2), 0), 0) AS r,
               any_value(coalesce(x1t, m1)) AS t1, any_value(coalesce(x2t, m2)) AS t2
        FROM (
          SELECT *, coalesce(x1r, m1) AS z1, coalesce(x2r, m2) AS z2 FROM (
            SELECT f.forecast_timestamp, f.target_id, f.target_reference_date, f.target_release_date, f.rn, f.y AS yt,
                   t.y AS yr, f.x AS x1t, f."feature_N_O_latest" AS x2t, t.x AS x1r, t."feature_N_O_latest" AS x2r,
                   median(t.x) OVER w AS m1, median(t."feature_N_O_latest") OVER w AS m2
            FROM ds f JOIN ds t ON f.target_id = t.target_id AND t.rn < f.rn WHERE f.rn > 24
            WINDOW w AS (PARTITION BY f.target_id, f.rn)))
        GROUP BY ALL))"""

ORACLE: dict[str, str] = {
    "read_observations": _with(f"SELECT {OBS6} FROM obs WHERE source = 'fred'", "obs"),
    "filter_series": _with(
        "SELECT series_id, source, date, value, release_date FROM obs WHERE series_id IN ('A_F', 'N_O') AND source = 'bls'",
        "obs",
    ),
    "coverage": _with(
        """SELECT source, series_id, count(*) AS row_count, min(date) AS min_date, max(date) AS max_date,
                  min(release_date) AS min_release_date, max(release_date) AS max_release_date,
                  count(*) - count(release_date) AS missing_release_date_count
           FROM obs GROUP BY source, series_id""",
        "obs",
    ),
    "distinct_series": _with("SELECT DISTINCT series_id FROM obs", "obs"),
    "duplicate_keys": _with(f"SELECT {KEY}, count(*) AS row_count FROM base GROUP BY ALL HAVING count(*) > 1", "base"),
    "release_date_key": _with(f"SELECT {LINE}, release_date_key FROM base", "base"),
    "coerce_observations": _with(f"SELECT {OBS6}, {LINE}, release_date_key FROM base", "base"),
    "validate_fred": _with(f"SELECT {OBS6} FROM obs WHERE source = 'fred' AND release_date IS NOT NULL", "obs"),
    "validate_bls": _with(f"SELECT {OBS6} FROM obs WHERE source = 'bls'", "obs"),
    "normalize_reference_period": _with(
        "SELECT strftime(date, '%Y-%m') AS reference_period, count(*) AS row_count FROM obs GROUP BY 1", "obs"
    ),
    "bls_period_to_date": _with(
        "SELECT strftime(date, '%Y') AS year, 'M' || strftime(date, '%m') AS period, date, count(*) AS row_count FROM obs GROUP BY ALL",
        "obs",
    ),
    "enrich_series": _with(
        """SELECT series_id, source, date, value, CASE WHEN source = 'fred' THEN 'Shipments ' || series_id END AS description,
                  CASE WHEN source = 'fred' THEN 'shipments' END AS category,
                  CASE WHEN source = 'fred' THEN 'daily' END AS frequency_hint FROM obs""",
        "obs",
    ),
    "normalize_fred": _with(
        """SELECT series_id, date, value, source, coalesce(release_date, DATE '2026-01-01') AS release_date
           FROM obs WHERE source = 'fred'
           UNION ALL
           SELECT series_id, CAST(date + INTERVAL 1 MONTH AS DATE), NULL, source,
                  CASE WHEN release_date IS NULL THEN DATE '2026-01-01' END
           FROM obs WHERE source = 'fred'""",
        "obs",
    ),
    "fred_release_date": _with(
        """SELECT series_id, date, value,
                  CASE l_orderkey % 3 WHEN 0 THEN release_date WHEN 1 THEN DATE '2020-02-02'
                       ELSE DATE '2026-01-01' END AS release_date
           FROM obs WHERE source = 'fred' AND release_date IS NOT NULL""",
        "obs",
    ),
    "merge_vintage_chunks": _with(f"SELECT DISTINCT {OBS6} FROM obs", "obs"),
    "union_distinct_chunks": _with("SELECT DISTINCT series_id, source, date, release_date FROM obs", "obs"),
    "normalize_bls": _with(
        """SELECT series_id, date, value, source, CAST(NULL AS DATE) AS release_date FROM obs WHERE source = 'bls'
           UNION ALL SELECT series_id, CAST(date + INTERVAL 1 MONTH AS DATE), NULL, source, NULL FROM obs WHERE source = 'bls'""",
        "obs",
    ),
    "validate_calendar": _with("SELECT * FROM cal", "cal"),
    "calendar_violations": _with(
        """SELECT 'bad_period' AS rule, count(*) FILTER (month(date) = 2) AS violations FROM idx
           UNION ALL SELECT 'bad_release_date', 0
           UNION ALL SELECT 'blank_release_time', count(*) FILTER (month(date) = 4) FROM idx
           UNION ALL SELECT 'released_before_month_end', count(*) FILTER (month(date) = 3) FROM idx
           UNION ALL SELECT 'duplicate_period', count(*)
                     FROM (SELECT date FROM idx WHERE month(date) <> 2 GROUP BY date HAVING count(*) > 1)""",
        "idx",
    ),
    "calendar_gaps": _with(
        "SELECT strftime(date, '%Y-%m') AS reference_period FROM idx EXCEPT SELECT reference_period FROM cal", "cal"
    ),
    "period_set_diff": _with(
        "SELECT strftime(date, '%Y-%m') AS reference_period FROM obs EXCEPT SELECT reference_period FROM cal",
        "obs",
        "cal",
    ),
    "calendar_range_gaps": _with(
        """SELECT strftime(m, '%Y-%m') AS reference_period
           FROM range(DATE '1994-11-01', DATE '2002-01-01', INTERVAL 1 MONTH) AS r(m)
           WHERE strftime(m, '%Y-%m') NOT IN (SELECT reference_period FROM cal)""",
        "cal",
    ),
    "calendar_summary": _with(
        """SELECT count(*) AS calendar_rows, min(reference_period) AS min_period, max(reference_period) AS max_period,
                  min(release_date) AS min_release_date, max(release_date) AS max_release_date FROM cal""",
        "cal",
    ),
    "map_release_dates": _with(
        """SELECT i.series_id, i.source, i.date, i.value, c.release_date
           FROM idx i LEFT JOIN cal c ON strftime(i.date, '%Y-%m') = c.reference_period""",
        "cal",
    ),
    "mom_target": _with("SELECT * FROM targets", "targets"),
    "mom_target_vintages": _with(
        """SELECT * FROM (
             SELECT 'mom_' || series_id AS target_id, source, date AS reference_date, release_date,
                    100 * (v / lag(v) OVER (PARTITION BY series_id, source ORDER BY date, release_date) - 1) AS target_value
             FROM (SELECT series_id, source, date, release_date, max(value) AS v FROM obs
                   WHERE release_date IS NOT NULL AND value IS NOT NULL GROUP BY ALL))
           WHERE target_value IS NOT NULL""",
        "obs",
    ),
    "validate_targets": _with("SELECT * FROM targets", "targets"),
    "target_shell": _with(
        """SELECT release_date AS forecast_timestamp, target_id, reference_date AS target_reference_date,
                  release_date AS target_release_date, target_value FROM targets""",
        "targets",
    ),
    "target_shell_relaxed": _with(
        """SELECT CASE WHEN month(reference_date) <> 4 THEN release_date END AS forecast_timestamp, target_id,
                  reference_date AS target_reference_date,
                  CASE WHEN month(reference_date) <> 4 THEN release_date END AS target_release_date, target_value
           FROM targets""",
        "targets",
    ),
    "normalize_targets": _with("SELECT * FROM shell", "shell"),
    "lagged_targets": _with(
        """SELECT *, lag(target_value, 1) OVER w AS feature_target_lag_1, lag(target_value, 2) OVER w AS feature_target_lag_2,
                  lag(target_value, 12) OVER w AS feature_target_lag_12
           FROM shell WINDOW w AS (PARTITION BY target_id ORDER BY target_reference_date)""",
        "shell",
    ),
    "percent_change": _with(
        """SELECT series_id, date, v AS value, 100 * (f / lag(f, 2) OVER w - 1) AS percent_change
           FROM (SELECT series_id, date, CASE WHEN month(date) <> 5 THEN value END AS v,
                        last_value(CASE WHEN month(date) <> 5 THEN value END IGNORE NULLS)
                          OVER (PARTITION BY series_id ORDER BY date) AS f
                 FROM idx)
           WINDOW w AS (PARTITION BY series_id ORDER BY date)""",
        "idx",
    ),
    "difference": _with(
        """SELECT series_id, date, v AS value, v - lag(v, 2) OVER (PARTITION BY series_id ORDER BY date) AS difference
           FROM (SELECT series_id, date, CASE WHEN month(date) <> 5 THEN value END AS v FROM idx)""",
        "idx",
    ),
    "rolling_z_score": _with(
        """SELECT series_id, date, CASE WHEN count(value) OVER w = 5
                  THEN round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) END AS rolling_z_score
           FROM daily WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
        "daily",
    ),
    "normalize_feature_obs": _with(
        """SELECT series_id, source, date, value, release_date FROM obs
           WHERE series_id IN ('A_F', 'R_O') AND release_date IS NOT NULL""",
        "obs",
    ),
    "latest_vintage": _with("SELECT series_id, release_date, date, source, value FROM cand", "cand"),
    "latest_by_source": _with(
        f"""SELECT series_id, source, release_date, date, value FROM obs WHERE release_date IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY series_id, source
                                       ORDER BY release_date DESC, date DESC, {LINE_DESC}) = 1""",
        "obs",
    ),
    "asof_features": _with("SELECT * FROM asof_matrix", "asof_matrix"),
    "asof_features_before": _with(
        f"""SELECT {BASE5}, max(CASE WHEN sid = 'A_O' THEN value END) AS "feature_A_O_latest",
                   max(CASE WHEN sid = 'R_O' THEN value END) AS "feature_R_O_latest"
            FROM (SELECT k.*, c.value FROM (SELECT shell.*, n.sid FROM shell, (VALUES ('A_O'), ('R_O')) n(sid)) k
                  ASOF LEFT JOIN cand c ON k.sid = c.series_id AND k.target_release_date > c.release_date)
            GROUP BY ALL""",
        "shell",
        "cand",
    ),
    "feature_missingness": _with(_MISSING, "asof_matrix"),
    "prepare_dataset": _with(f'SELECT {BASE5}, "feature_A_F_latest" FROM asof_matrix', "asof_matrix"),
    "fold_number": _with(f"SELECT {BASE5}, rn - 24 AS fold_number FROM ds WHERE rn > 24", "ds"),
    "naive_predictions": _with(
        """SELECT *, lag(target_value) OVER (PARTITION BY target_id ORDER BY forecast_timestamp, target_reference_date) AS prediction
           FROM shell""",
        "shell",
    ),
    "usable_features": _with(
        f"""SELECT {KEYS3}, rn - 24 AS fold_number, u AS usable_features
            FROM (SELECT *, concat_ws(',', {_USABLE}) AS u FROM ds
                  WINDOW w AS (PARTITION BY target_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
            WHERE rn > 24""",
        "ds",
    ),
    "expanding_moments": _with(_MOMENTS, "ds"),
    "walk_forward_naive": _with("SELECT * FROM naive", "naive"),
    "walk_forward_naive_pooled": _with(
        f"""SELECT * FROM (SELECT {KEYS4}, y AS actual, lag(y) OVER (ORDER BY prn) AS prediction,
                                  'naive_last_value' AS model_name, prn - 24 AS fold_number FROM ds)
            WHERE fold_number >= 1""",
        "ds",
    ),
    "walk_forward_ridge": _with("SELECT * REPLACE (round(prediction, 6) AS prediction) FROM ridge", "ridge"),
    "walk_forward_ridge_pooled": _with(
        "SELECT * REPLACE (round(prediction, 6) AS prediction) FROM ("
        + CTES["ridge"]
        .replace("PARTITION BY f.target_id, f.rn", "PARTITION BY f.prn")
        .replace("f.target_id = t.target_id AND t.rn < f.rn WHERE f.rn > 24", "t.prn < f.prn WHERE f.prn > 24")
        .replace("f.target_release_date, f.rn,", "f.target_release_date, f.prn AS rn,")
        + ")",
        "ds",
    ),
    "walk_forward_ridge_two": _with(_RIDGE_TWO, "ds"),
    "fit_predict_ridge": _with(
        """SELECT forecast_timestamp, target_id, target_reference_date, target_release_date, target_value,
                  "feature_A_F_latest", round(yb + n / (n + 1.0) * c / v * (coalesce(x, m) - zb), 6) AS prediction
           FROM ds, (SELECT count(*) AS n, avg(y) AS yb, avg(z) AS zb, covar_pop(z, y) AS c, var_pop(z) AS v, any_value(m) AS m
                     FROM (SELECT y, m, coalesce(x, m) AS z FROM
                            (SELECT y, x, median(x) OVER () AS m FROM ds WHERE forecast_timestamp < TIMESTAMP '1999-01-01')))
           WHERE forecast_timestamp >= TIMESTAMP '1999-01-01'""",
        "ds",
    ),
    "fit_predict_stump": _with(
        _stump(
            "SELECT TIMESTAMP '1999-01-01' AS c, count(*) AS nb FROM ds WHERE forecast_timestamp < TIMESTAMP '1999-01-01'",
            """SELECT forecast_timestamp, target_id, target_reference_date, target_release_date, target_value,
                      "feature_A_F_latest", round(p, 6) AS prediction""",
            "f.forecast_timestamp >= m.c",
        ),
        "ds",
    ),
    "walk_forward_stump": _with(
        _stump(
            """SELECT c, count(*) AS nb FROM (SELECT DISTINCT forecast_timestamp AS c FROM ds WHERE rn > 24) JOIN ds ON forecast_timestamp < c
               GROUP BY c""",
            f"""SELECT {KEYS4}, y AS actual, round(p, 6) AS prediction, 'boosted_trees' AS model_name, rn - 24 AS fold_number""",
            "f.forecast_timestamp = m.c AND f.rn > 24",
        ),
        "ds",
    ),
    "supervised_guard": _with(
        """SELECT count(*) AS train_rows, count("feature_A_F_latest") AS "known_feature_A_F_latest",
                  count("feature_N_O_latest") AS "known_feature_N_O_latest" FROM ds""",
        "ds",
    ),
    "mae": _with("SELECT model_name, round(mae, 6) AS mae FROM levels", "levels"),
    "rmse": _with("SELECT model_name, round(rmse, 6) AS rmse FROM levels", "levels"),
    "level_direction": _with("SELECT model_name, round(level_direction, 6) AS level_direction FROM levels", "levels"),
    "change_direction": _with(f"SELECT model_name, {KEYS3}, same_direction FROM moves", "moves"),
    "evaluate_forecasts": _with(
        """SELECT model_name, round(rmse, 6) AS rmse, round(mae, 6) AS mae,
                  round(directional_accuracy, 6) AS directional_accuracy, n_forecasts FROM scores""",
        "scores",
    ),
    "align_loose": _with(
        f"""SELECT {KEYS4}, r.actual AS actual_model, round(r.prediction, 6) AS prediction_model, n.actual AS actual_naive,
                   round(n.prediction, 6) AS prediction_naive
            FROM ridge r JOIN naive n USING ({KEYS4})""",
        "fc",
    ),
    "align_strict": _with(
        f"""SELECT m.model_name, {KEYS3}, m.target_release_date AS target_release_date_model, m.actual AS actual_model,
                   round(m.prediction, 6) AS prediction_model, n.target_release_date AS target_release_date_naive,
                   n.actual AS actual_naive, round(n.prediction, 6) AS prediction_naive
            FROM fc m JOIN naive n USING ({KEYS3})""",
        "fc",
    ),
    "normalize_forecasts": _with("SELECT * REPLACE (round(prediction, 6) AS prediction) FROM fc", "fc"),
    "normalize_report_inputs": _with(
        """SELECT * REPLACE (round(prediction, 6) AS prediction, CASE WHEN fold_number % 5 <> 0 THEN actual END AS actual)
           FROM fc""",
        "fc",
    ),
    "key_set_diff": _with(f"SELECT {KEYS3}, 'model' AS missing_from FROM naive WHERE fold_number <= 6", "naive"),
    "compare_to_naive": _with(
        """SELECT round(r.rmse, 6) AS model_rmse, round(n.rmse, 6) AS naive_rmse, round(n.rmse - r.rmse, 6) AS rmse_improvement,
                  round(r.mae, 6) AS model_mae, round(n.mae, 6) AS naive_mae, round(n.mae - r.mae, 6) AS mae_improvement,
                  CAST(r.rmse < n.rmse AS DOUBLE) AS model_beats_naive_rmse, CAST(r.mae < n.mae AS DOUBLE) AS model_beats_naive_mae
           FROM levels r, levels n WHERE r.model_name = 'ridge' AND n.model_name = 'naive_last_value'""",
        "levels",
    ),
    "metrics_row": _with(
        """SELECT model_name, n_forecasts, round(rmse, 6) AS rmse, round(mae, 6) AS mae,
                  round(directional_accuracy, 6) AS directional_accuracy, beats_naive_rmse, beats_naive_mae,
                  round(rmse_vs_naive, 6) AS rmse_vs_naive, round(mae_vs_naive, 6) AS mae_vs_naive FROM metrics""",
        "metrics",
    ),
    "compare_models_linear": _with(
        """SELECT model_name, n_forecasts, round(rmse, 6) AS rmse, round(mae, 6) AS mae,
                  round(directional_accuracy, 6) AS directional_accuracy, beats_naive_rmse, beats_naive_mae,
                  round(rmse_vs_naive, 6) AS rmse_vs_naive, round(mae_vs_naive, 6) AS mae_vs_naive FROM metrics""",
        "metrics",
    ),
    "verdicts": _with(
        """SELECT model_name, CASE WHEN beats_naive_rmse = 1 THEN 'beats' ELSE 'does not beat' END AS rmse_verdict,
                  CASE WHEN beats_naive_mae = 1 THEN 'beats' ELSE 'does not beat' END AS mae_verdict
           FROM metrics WHERE model_name <> 'naive_last_value'""",
        "metrics",
    ),
    "metric_bars": _with(
        """SELECT model_name, 'rmse' AS metric, round(rmse, 6) AS value FROM metrics
           UNION ALL SELECT model_name, 'mae', round(mae, 6) FROM metrics""",
        "metrics",
    ),
    "union_forecasts": _with("SELECT * REPLACE (round(prediction, 6) AS prediction) FROM fc", "fc"),
    "plot_ready_forecasts": _with("SELECT * REPLACE (round(prediction, 6) AS prediction) FROM fc", "fc"),
    "forecast_counts": _with("SELECT model_name, count(*) AS forecast_count FROM fc GROUP BY model_name", "fc"),
    "actual_stats": _with(
        "SELECT round(avg(actual), 6) AS actual_mean, round(stddev_samp(actual), 6) AS actual_std FROM fc", "fc"
    ),
    "prediction_stats": _with(
        """SELECT model_name, round(avg(prediction), 6) AS prediction_mean, round(stddev_samp(prediction), 6) AS prediction_std
           FROM fc GROUP BY model_name""",
        "fc",
    ),
    "forecast_summary": _with(
        """SELECT count(DISTINCT model_name) AS models, count(*) AS forecast_rows,
                  count(DISTINCT forecast_timestamp) AS unique_timestamps, min(forecast_timestamp) AS min_timestamp,
                  max(forecast_timestamp) AS max_timestamp, string_agg(DISTINCT target_id, ', ' ORDER BY target_id) AS target_ids
           FROM fc""",
        "fc",
    ),
    "actuals_series": _with(
        """SELECT 'actual' AS series, forecast_timestamp,
                  round(arg_min(actual, ROW(model_name, target_id, target_reference_date)), 6) AS y
           FROM fc GROUP BY forecast_timestamp
           UNION ALL SELECT model_name || ' prediction', forecast_timestamp, round(prediction, 6) FROM fc""",
        "fc",
    ),
    "forecast_errors": _with(
        "SELECT model_name, forecast_timestamp, round(prediction - actual, 6) AS error FROM fc", "fc"
    ),
    "upsert_changes": _with("SELECT * FROM changes", "changes"),
    "upsert_counts": _with(
        """SELECT count(*) AS rows_seen, count(*) FILTER (action = 'inserted') AS inserted,
                  count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'skipped') AS skipped
           FROM changes""",
        "changes",
    ),
    "upsert_result": _with(
        f"""SELECT {OBS6}, release_date_key FROM (
              SELECT {OBS6}, release_date_key, {LINE}, 1 AS is_new FROM batch
              UNION ALL SELECT {OBS6}, release_date_key, {LINE}, 0 AS is_new FROM stored)
            QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY is_new DESC, {LINE_DESC}) = 1""",
        "batch",
        "stored",
    ),
    "read_release_calendar": _with("SELECT * FROM cal", "cal"),
    "read_dataset": _with(f'SELECT {BASE5}, "feature_A_F_latest" FROM asof_matrix', "asof_matrix"),
    "read_forecasts": _with("SELECT * REPLACE (round(prediction, 6) AS prediction) FROM fc", "fc"),
    "read_metrics": _with(
        """SELECT model_name, n_forecasts, round(rmse, 6) AS rmse, round(mae, 6) AS mae,
                  round(directional_accuracy, 6) AS directional_accuracy, beats_naive_rmse, beats_naive_mae,
                  round(rmse_vs_naive, 6) AS rmse_vs_naive, round(mae_vs_naive, 6) AS mae_vs_naive FROM metrics""",
        "metrics",
    ),
    "stable_output_order": _with(
        """SELECT model_name, forecast_timestamp, target_id,
                  row_number() OVER (ORDER BY model_name, forecast_timestamp, target_id) AS place FROM fc""",
        "fc",
    ),
    "preview": _with(
        f"""SELECT {BASE5}, "feature_A_F_latest", (SELECT count(*) FROM asof_matrix) AS total_rows FROM asof_matrix
            ORDER BY {KEYS3} LIMIT 10""",
        "asof_matrix",
    ),
    "insert_observations": _with(f"SELECT {OBS6} FROM stored", "stored"),
    "run_ingestion": _with(
        """SELECT CAST(1 AS BIGINT) AS id, 'fred' AS source, 'ALL' AS series_id, 'succeeded' AS status, count(*) AS rows_seen,
                  count(*) AS inserted, CAST(0 AS BIGINT) AS updated, CAST(0 AS BIGINT) AS skipped,
                  '{"from": "1990", "mode": "current"}' AS parameters_json
           FROM stored WHERE source = 'fred' AND release_date IS NOT NULL""",
        "stored",
    ),
    "comparison_report": _with(
        """SELECT m.model_name, round(m.rmse, 6) AS rmse, round(m.mae, 6) AS mae, count(*) AS forecast_count,
                  round(avg(f.prediction), 6) AS prediction_mean, round(stddev_samp(f.prediction), 6) AS prediction_std
           FROM metrics m JOIN fc f ON f.model_name = m.model_name GROUP BY m.model_name, m.rmse, m.mae""",
        "metrics",
        "fc",
    ),
    "run_states": """
        SELECT event_id AS id, event_type AS source, 'user_' || user_id AS series_id,
               CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status, ts AS started_at,
               ts + INTERVAL 1 MINUTE AS finished_at, CASE WHEN event_type = 'error' THEN 0 ELSE user_id END AS rows_seen,
               CASE WHEN event_type = 'error' THEN 'error' END AS error_message
        FROM events""",
    "list_runs": """
        SELECT event_id AS id, event_type AS source, 'failed' AS status, ts AS started_at FROM events
        WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 25""",
    "get_run": """
        SELECT event_id AS id, event_type AS source, 'user_' || user_id AS series_id,
               CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status, ts AS started_at,
               CASE WHEN event_type = 'error' THEN 0 ELSE user_id END AS rows_seen
        FROM events WHERE event_id = 77""",
}
