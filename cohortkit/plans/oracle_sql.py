"""DuckDB SQL equivalents of the driver-table queries (the correctness oracle).

Written independently of the Spark code: joins and window functions over the
same tables, pairs where that is the plain definition (the oracle runs on
small data only).  Floats rounded to 6 places, as on the Spark side.
"""

from __future__ import annotations

from cohortkit.plans.driver_tables import CUTOFFS, DOSE_CLASSES, FIRST_TYPES, PART_TYPES, PRIORITIES, TESTS

STATS = ("mean", "median", "max", "min", "range", "sd", "iqr", "first", "last", "count")
HORIZONS = (2, 7, 30)
DAY_US = "86400000000.0"

_CUT_VALUES = ", ".join(f"('{k}', {v})" for k, v in CUTOFFS.items())

MEASURES = f"""
  m AS (SELECT e.user_id, e.event_id, e.ts, e.event_type, e.value
        FROM events e JOIN (VALUES {_CUT_VALUES}) AS c(event_type, cutoff) ON e.event_type = c.event_type
        WHERE e.value < c.cutoff)"""


def _stat_exprs(v: str, order: str) -> str:
    return f"""avg({v}) AS mean, median({v}) AS median, max({v}) AS "max", min({v}) AS "min",
      max({v}) - min({v}) AS "range", coalesce(stddev_samp({v}), 0) AS sd,
      quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25) AS iqr,
      arg_min({v}, {order}) AS "first", arg_max({v}, {order}) AS "last", count(*) AS "count\""""


def _round_stats(prefix: str = "") -> str:
    return ", ".join(f'round({prefix}"{s}", 6) AS "{s}"' if s != "count" else f'{prefix}"count" AS "count"'
                     for s in STATS)


HISTORY = f"""
WITH {MEASURES},
  i AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'),
  h AS (SELECT i.user_id, m.event_type, i.event_id, {_stat_exprs('m.value', '(m.ts, m.event_id)')}
        FROM i JOIN m ON i.user_id = m.user_id AND m.ts < i.ts
        GROUP BY i.user_id, m.event_type, i.event_id)"""

_wide_cols = ",\n  ".join(
    (f"""round(max(CASE WHEN event_type = '{t}' THEN "{s}" END), 6) AS "{s}_{t}\"""" if s != "count" else
     f"""max(CASE WHEN event_type = '{t}' THEN "count" END) AS "count_{t}\"""")
    for t in TESTS for s in STATS)


def _flag_sql(test_ts: str, t0: str, h: int) -> str:
    return f"({test_ts} >= {t0} + INTERVAL 1 DAY AND {test_ts} <= {t0} + INTERVAL {h} DAY)"


def _code_sql(code_col: str, code: str, end: str, t0: str, h: int, as_executed: bool = False) -> str:
    hi = 1 if (as_executed and h == 2) else h
    return f"({code_col} = '{code}' AND {end} <= {t0} + INTERVAL {hi} DAY AND {end} > {t0} + INTERVAL 1 DAY)"


def _days(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / {DAY_US})"


LABEL_INPUTS = """
WITH idx AS (SELECT user_id, event_id, ts AS t0 FROM events WHERE event_type = 'purchase'),
  tst AS (SELECT user_id, ts AS test_ts FROM events WHERE event_type = 'error' AND value > 100),
  codes AS (SELECT DISTINCT user_id, 'S300' AS code FROM events WHERE event_type = 'signup' AND value > 300),
  ends AS (SELECT user_id, max(ts) AS end_ts FROM events GROUP BY user_id),
  x AS (SELECT idx.user_id, idx.event_id, idx.t0, tst.test_ts, codes.code, ends.end_ts
        FROM idx LEFT JOIN tst ON idx.user_id = tst.user_id
                 LEFT JOIN codes ON idx.user_id = codes.user_id
                 LEFT JOIN ends ON idx.user_id = ends.user_id)"""

_label_cols = ",\n  ".join(
    [f"coalesce(CAST({_flag_sql('test_ts', 't0', h)} OR {_code_sql('code', 'S300', 'end_ts', 't0', h)} AS INTEGER), 0)"
     f" AS flag_{h}d" for h in HORIZONS]
    + [f"CAST({_flag_sql('test_ts', 't0', h)} AS INTEGER) AS test_{h}d" for h in HORIZONS]
    + [f"CAST({_code_sql('code', 'S300', 'end_ts', 't0', h)} AS INTEGER) AS code_{h}d" for h in HORIZONS]
    + [f"coalesce(CAST({_flag_sql('test_ts', 't0', 30)} OR {_code_sql('code', 'S300', 'end_ts', 't0', 30)} AS INTEGER), 0)"
       " AS surv_flag",
       f"round(CASE WHEN {_flag_sql('test_ts', 't0', 30)} THEN {_days('t0', 'test_ts')} "
       f"ELSE {_days('t0', 'end_ts')} END, 6) AS surv_days"])

_label_cols_exec = ",\n  ".join(
    [f"coalesce(CAST({_flag_sql('test_ts', 't0', h)} OR {_code_sql('code', 'S300', 'end_ts', 't0', h, True)}"
     f" AS INTEGER), 0) AS flag_{h}d" for h in HORIZONS]
    + [f"coalesce(CAST({_flag_sql('test_ts', 't0', 30)} AS INTEGER), 0) AS surv_flag",
       f"round(CASE WHEN {_flag_sql('test_ts', 't0', 30)} THEN {_days('t0', 'test_ts')} "
       f"ELSE {_days('t0', 'end_ts')} END, 6) AS surv_days"])

SURVIVAL = f"""
  s0 AS (SELECT l.l_orderkey, l.l_linenumber, l.l_extendedprice,
                {_days('o.o_orderdate', 'l.l_shipdate')} AS days,
                CAST(l.l_returnflag = 'R' AS INTEGER) AS event
         FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
  f AS (SELECT * FROM s0 WHERE days > 0 AND days < 120)"""

SCORED = """
  sd AS (SELECT l.doc_id, l.quality, d.lang, d.n_chars, CAST(d.n_chars >= 2000 AS INTEGER) AS pred
         FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def _curve(group: str = "") -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""
WITH {SCORED},
  s AS (SELECT {g}CAST(n_chars AS DOUBLE) AS threshold,
               sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS pos,
               sum(CASE WHEN quality <> 1 THEN 1 ELSE 0 END) AS neg
        FROM sd GROUP BY ALL),
  c AS (SELECT *, sum(pos) OVER (PARTITION BY {group or "1"} ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS cp,
                 sum(neg) OVER (PARTITION BY {group or "1"} ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS cn,
                 sum(pos) OVER ({part}) AS "P", sum(neg) OVER ({part}) AS "N"
        FROM s)"""


def _report_sql() -> str:
    return f"""
WITH {SCORED},
  cm AS (SELECT lang,
           sum(CASE WHEN quality = 1 AND pred = 1 THEN 1 ELSE 0 END)::BIGINT AS tp,
           sum(CASE WHEN quality = 0 AND pred = 1 THEN 1 ELSE 0 END)::BIGINT AS fp,
           sum(CASE WHEN quality = 1 AND pred = 0 THEN 1 ELSE 0 END)::BIGINT AS fn,
           sum(CASE WHEN quality = 0 AND pred = 0 THEN 1 ELSE 0 END)::BIGINT AS tn
         FROM sd GROUP BY lang),
  per AS (
    SELECT lang, '1' AS class,
           CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p,
           CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r, tp + fn AS support FROM cm
    UNION ALL
    SELECT lang, '0' AS class,
           CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0.0 END AS p,
           CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS r, tn + fp AS support FROM cm),
  per2 AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM per),
  allrows AS (
    SELECT lang, class, p AS precision, r AS recall, f AS f1_score, support FROM per2
    UNION ALL
    SELECT lang, 'accuracy', a, a, a, n FROM (
      SELECT lang, CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) / (tp + tn + fp + fn) ELSE 0.0 END AS a,
             tp + tn + fp + fn AS n FROM cm)
    UNION ALL
    SELECT lang, 'macro avg', avg(p), avg(r), avg(f), sum(support)::BIGINT FROM per2 GROUP BY lang
    UNION ALL
    SELECT lang, 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
           sum(f * support) / sum(support), sum(support)::BIGINT FROM per2 GROUP BY lang)
SELECT lang, class, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1_score, 6) AS f1_score, support::BIGINT AS support FROM allrows"""


def _km_sql() -> str:
    z = "1.959963984540054"
    eps = "2.220446049250313e-16"
    lp = "ln(greatest(survival, 1e-300))"
    return f"""
WITH {SURVIVAL},
  t AS (SELECT days AS time, sum(event) AS d, count(*) AS n_all FROM f GROUP BY days),
  r AS (SELECT *, sum(n_all) OVER (ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS n FROM t),
  k AS (SELECT *,
          sum(CASE WHEN n > d THEN ln(1 - d / n) ELSE 0 END) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING) AS cl,
          sum(CASE WHEN n = d THEN 1 ELSE 0 END) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING) AS cz,
          sum(CASE WHEN n > d THEN d / (n * (n - d)) ELSE 0 END) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING) AS gw
        FROM r),
  v AS (SELECT *, CASE WHEN cz > 0 THEN 0.0 ELSE exp(cl) END AS survival FROM k)
SELECT round(time, 6) AS time, n::BIGINT AS n_at_risk, d::BIGINT AS n_events, (n_all - d)::BIGINT AS n_censored,
  round(survival, 6) AS survival,
  round(CASE WHEN survival <= {eps} THEN 0.0
             WHEN {lp} < -{eps} THEN exp(exp(-{z} * sqrt(gw) / {lp}) * {lp}) ELSE survival END, 6) AS ci_lower,
  round(CASE WHEN survival <= {eps} THEN 0.0
             WHEN {lp} < -{eps} THEN exp(exp({z} * sqrt(gw) / {lp}) * {lp}) ELSE survival END, 6) AS ci_upper
FROM v"""


def _training_sql() -> str:
    one_hot_ab = ", ".join(f"coalesce(max(CASE WHEN dose_class = '{c}' THEN 1 END), 0) AS ab_class_is_{c}"
                           for c in DOSE_CLASSES)
    one_hot_ad = ", ".join(f"coalesce(max(CASE WHEN admission_type = '{c}' THEN 1 END), 0) AS admit_is_{c}"
                           for c in FIRST_TYPES)
    feat_cols = ", ".join(f'fe."{s}_{t}"' for t in TESTS for s in STATS)
    wide = ",\n  ".join(
        f"""max(CASE WHEN event_type = '{t}' THEN "{s}" END) AS "{s}_{t}\"""" for t in TESTS for s in STATS)
    lab = []
    for h in HORIZONS:
        lab.append(f"coalesce(CAST({_flag_sql('cdiff_charttime', 'ab_startdate', h)} OR "
                   f"{_code_sql('cdiff_icd9', '00845', 'dischtime', 'ab_startdate', h)} AS INTEGER), 0) AS cdiff_{h}d_flag")
    lab.append(f"coalesce(CAST({_flag_sql('cdiff_charttime', 'ab_startdate', 30)} OR "
               f"{_code_sql('cdiff_icd9', '00845', 'dischtime', 'ab_startdate', 30)} AS INTEGER), 0) AS cdiff_survival_flag")
    lab.append(f"CASE WHEN {_flag_sql('cdiff_charttime', 'ab_startdate', 30)} "
               f"THEN {_days('ab_startdate', 'cdiff_charttime')} ELSE {_days('ab_startdate', 'dischtime')} END"
               " AS survival_time")
    src = [f"CAST({_flag_sql('cdiff_charttime', 'ab_startdate', h)} AS INTEGER) AS cdiff_label_elisa_{h}d"
           for h in HORIZONS]
    src += [f"CAST({_code_sql('cdiff_icd9', '00845', 'dischtime', 'ab_startdate', h)} AS INTEGER)"
            f" AS cdiff_label_icd9_{h}d" for h in HORIZONS]
    return f"""
WITH {MEASURES},
  p AS (SELECT user_id, event_id, ts, value FROM events WHERE event_type = 'purchase'),
  idx AS (SELECT user_id AS subject_id, user_id AS hadm_id, user_id AS icustay_id,
                 concat_ws('_', user_id, user_id, user_id, event_id, 'purchase') AS antibiotic_key,
                 ts AS ab_startdate, {one_hot_ab}
          FROM (SELECT *, CASE WHEN value < 100 THEN 'low' WHEN value < 250 THEN 'mid' ELSE 'high' END AS dose_class
                FROM p) GROUP BY ALL),
  tests AS (SELECT user_id AS subject_id, user_id AS hadm_id, ts AS cdiff_charttime
            FROM events WHERE event_type = 'error' AND value > 100),
  codes AS (SELECT DISTINCT user_id AS subject_id, user_id AS hadm_id, '00845' AS cdiff_icd9
            FROM events WHERE event_type = 'signup' AND value > 300),
  diar AS (SELECT DISTINCT user_id AS subject_id, user_id AS hadm_id FROM events
           WHERE event_type = 'click' AND value > 400),
  users AS (SELECT user_id, min(ts) AS admittime, max(ts) AS dischtime,
                   arg_min(event_type, (ts, event_id)) AS admission_type,
                   max(event_type = 'view' AND value > 200) AS fem
            FROM events GROUP BY user_id),
  demo AS (SELECT user_id AS subject_id, user_id AS hadm_id, CAST(fem AS INTEGER) AS is_female,
                  admittime - to_days(CAST(user_id * 250 AS INTEGER)) AS dob, admittime, dischtime, {one_hot_ad}
           FROM users GROUP BY ALL),
  icu AS (SELECT user_id AS subject_id, user_id AS hadm_id, user_id AS icustay_id,
                 admittime AS icu_intime, admittime + INTERVAL 7 DAY AS icu_outtime FROM users),
  h AS (SELECT i.subject_id, i.hadm_id, i.antibiotic_key, m.event_type,
               {_stat_exprs('m.value', '(m.ts, m.event_id)')}
        FROM idx i JOIN m ON i.subject_id = m.user_id AND m.ts < i.ab_startdate
        GROUP BY i.subject_id, i.hadm_id, i.antibiotic_key, m.event_type),
  feats AS (SELECT subject_id, hadm_id, antibiotic_key, {wide} FROM h GROUP BY subject_id, hadm_id, antibiotic_key),
  j AS (SELECT idx.*, tests.cdiff_charttime, codes.cdiff_icd9, demo.is_female, demo.dob, demo.admittime,
               demo.dischtime, {", ".join(f"demo.admit_is_{c}" for c in FIRST_TYPES)}, {feat_cols}
        FROM idx
        LEFT JOIN tests ON idx.subject_id = tests.subject_id AND idx.hadm_id = tests.hadm_id
        LEFT JOIN codes ON idx.subject_id = codes.subject_id AND idx.hadm_id = codes.hadm_id
        LEFT JOIN diar ON idx.subject_id = diar.subject_id AND idx.hadm_id = diar.hadm_id
        LEFT JOIN demo ON idx.subject_id = demo.subject_id AND idx.hadm_id = demo.hadm_id
        LEFT JOIN icu ON idx.subject_id = icu.subject_id AND idx.hadm_id = icu.hadm_id
                     AND idx.icustay_id = icu.icustay_id
        LEFT JOIN feats fe ON idx.subject_id = fe.subject_id AND idx.hadm_id = fe.hadm_id
                     AND idx.antibiotic_key = fe.antibiotic_key),
  d AS (SELECT *,
          (epoch_us(date_trunc('day', ab_startdate)) - epoch_us(dob)) / (365 * {DAY_US}) AS age_at_admin,
          greatest((epoch_us(date_trunc('day', ab_startdate)) - epoch_us(date_trunc('day', admittime)))
                   / 3600000000.0, 0) AS admin_time_since_admission,
          CAST(hour(admittime) AS DOUBLE) AS admission_time_of_day,
          {", ".join(lab)}
        FROM j),
  q AS (SELECT *, {", ".join(src)} FROM d WHERE age_at_admin < 100 AND admin_time_since_admission <= 1440)
SELECT {", ".join(_training_out())}
FROM q"""


def _training_out() -> list[str]:
    ints = ([f"ab_class_is_{c}" for c in DOSE_CLASSES] + ["is_female"] + [f"admit_is_{c}" for c in FIRST_TYPES]
            + [f"count_{t}" for t in TESTS] + [f"cdiff_{h}d_flag" for h in HORIZONS] + ["cdiff_survival_flag"]
            + [f"cdiff_label_elisa_{h}d" for h in HORIZONS] + [f"cdiff_label_icd9_{h}d" for h in HORIZONS])
    dbl = ([f"{s}_{t}" for t in TESTS for s in STATS if s != "count"]
           + ["age_at_admin", "admin_time_since_admission", "admission_time_of_day", "survival_time"])
    return [f'"{c}"' for c in ints] + [f'round("{c}", 6) AS "{c}"' for c in dbl]


ORACLE = {
    "history_all_users": f"""
WITH {MEASURES},
  i AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase'),
  h AS (SELECT m.event_type, i.event_id, {_stat_exprs('m.value', '(m.ts, m.event_id)')}
        FROM i JOIN m ON m.ts < i.ts GROUP BY m.event_type, i.event_id)
SELECT event_type, event_id, {_round_stats()}
FROM (SELECT * REPLACE (mean + CAST(1e-9 AS DOUBLE) AS mean) FROM h)""",

    "history_panel_stats": f"""{HISTORY}
SELECT user_id, event_type, event_id, {_round_stats()} FROM h""",

    "history_panel_wide": f"""{HISTORY}
SELECT user_id, event_id,
  {_wide_cols}
FROM h GROUP BY user_id, event_id""",

    "group_summary": f"""
SELECT user_id, event_type, {_round_stats()} FROM (
  SELECT user_id, event_type, {_stat_exprs('value', '(ts, event_id)')} FROM events GROUP BY user_id, event_type)""",

    "index_class_onehot": f"""
WITH lk AS (SELECT p_partkey, split_part(p_type, ' ', 1) AS p_class FROM part WHERE p_size <= 5),
  x AS (SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_partkey,
               concat_ws('_', l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_partkey) AS item_key, lk.p_class
        FROM lineitem l JOIN lk ON l.l_partkey = lk.p_partkey)
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, item_key,
  {", ".join(f"coalesce(max(CASE WHEN p_class = '{c}' THEN 1 END), 0) AS class_is_{c}" for c in PART_TYPES)}
FROM x GROUP BY l_orderkey, l_linenumber, l_suppkey, l_partkey, item_key""",

    "demographics_onehot": f"""
SELECT o.o_orderkey, o.o_custkey, CAST(c.c_mktsegment = 'BUILDING' AS INTEGER) AS is_building,
  {", ".join(f'''coalesce(max(CASE WHEN o.o_orderpriority = '{p}' THEN 1 END), 0) AS "prio_is_{p}"''' for p in PRIORITIES)}
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
GROUP BY o.o_orderkey, o.o_custkey, CAST(c.c_mktsegment = 'BUILDING' AS INTEGER)""",

    "outcome_tests": """
SELECT user_id, event_id, epoch_us(ts) / 1000000.0 AS outcome_ts, value AS outcome_value
FROM events WHERE event_type = 'error' AND value > 100""",

    "label_windows": f"""{LABEL_INPUTS}
SELECT user_id, event_id, round(epoch_us(test_ts) / 1000000.0, 6) AS test_time,
  {_label_cols}
FROM x""",

    "label_windows_as_executed": f"""{LABEL_INPUTS}
SELECT user_id, event_id,
  {_label_cols_exec}
FROM x""",

    "composite_label": f"""
WITH idx AS (SELECT user_id, event_id, ts AS t0 FROM events WHERE event_type = 'purchase'),
  tst AS (SELECT user_id, ts AS test_ts FROM events WHERE event_type = 'error' AND value > 100),
  dia AS (SELECT DISTINCT user_id, 'C400' AS dcode FROM events WHERE event_type = 'click' AND value > 400)
SELECT idx.user_id, idx.event_id,
  max(coalesce(CAST({_flag_sql('tst.test_ts', 'idx.t0', 30)} AND dia.dcode = 'C400' AS INTEGER), 0)) AS composite_30d
FROM idx LEFT JOIN tst ON idx.user_id = tst.user_id LEFT JOIN dia ON idx.user_id = dia.user_id
GROUP BY idx.user_id, idx.event_id""",

    "stay_interval": """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey,
  CAST(l.l_shipdate BETWEEN o.o_orderdate AND o.o_orderdate + INTERVAL 30 DAY AS INTEGER) AS in_stay
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",

    "elapsed_features": f"""
SELECT l_orderkey, l_linenumber, l_partkey, round(years, 6) AS years, round(hours, 6) AS hours,
       round(hour_of_day, 6) AS hour_of_day FROM (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey,
    (epoch_us(date_trunc('day', l.l_shipdate)) - epoch_us(o.o_orderdate)) / (365 * {DAY_US}) AS years,
    greatest((epoch_us(date_trunc('day', l.l_shipdate)) - epoch_us(date_trunc('day', o.o_orderdate)))
             / 3600000000.0, 0) AS hours,
    CAST(hour(o.o_orderdate) AS DOUBLE) AS hour_of_day
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
WHERE years < 5 AND hours <= 1440""",

    "cardinality_check": """
WITH a AS (SELECT user_id, count(*) AS na FROM events WHERE event_type = 'purchase' GROUP BY user_id),
  b AS (SELECT user_id, count(*) AS nb FROM events WHERE event_type = 'error' AND value > 100 GROUP BY user_id),
  j AS (SELECT a.na, b.nb FROM a JOIN b ON a.user_id = b.user_id),
  r AS (SELECT coalesce(max(na), 0)::BIGINT AS max_left_per_key, coalesce(max(nb), 0)::BIGINT AS max_right_per_key,
               count(*)::BIGINT AS matched_keys, coalesce(sum(na * nb), 0)::BIGINT AS joined_rows FROM j)
SELECT *, CASE WHEN max_left_per_key > 1 AND max_right_per_key > 1 THEN 'many-to-many'
               WHEN max_left_per_key > 1 THEN 'many-to-one'
               WHEN max_right_per_key > 1 THEN 'one-to-many' ELSE 'one-to-one' END AS relationship
FROM r""",

    "first_index_per_key": """
SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_event_id, count(*) AS n_index
FROM events WHERE event_type = 'purchase' GROUP BY user_id""",

    "dose_merge": """
WITH p AS (SELECT user_id, event_id, ts,
             CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS new_s
           FROM events WHERE event_type = 'purchase'
           WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT *, sum(new_s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM p)
SELECT user_id, min(event_id) AS first_event_id, count(*) AS doses FROM s GROUP BY user_id, sid""",

    "prior_outcome_flag": """
WITH f AS (SELECT user_id, min(ts) AS first_test FROM events WHERE event_type = 'error' AND value > 100
           GROUP BY user_id)
SELECT p.user_id, p.event_id, coalesce(CAST(f.first_test < p.ts AS INTEGER), 0) AS prior_outcome
FROM events p LEFT JOIN f ON p.user_id = f.user_id WHERE p.event_type = 'purchase'""",

    "count_by_label": "SELECT quality, count(*) AS n FROM labels GROUP BY quality",

    "class_balance": """
SELECT negatives, positives, round(negatives / positives, 6) AS ratio FROM (
  SELECT sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END)::BIGINT AS negatives,
         sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)::BIGINT AS positives FROM labels)""",

    "case_rate_by_lang": """
SELECT d.lang, round(avg(CAST(l.quality AS DOUBLE)), 6) AS case_rate
FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY d.lang""",

    "schema_profile": """
SELECT CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
         WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS type,
       count(*) AS n_columns, CAST(sum(n) AS BIGINT) AS n_values
FROM (DESCRIBE lineitem) JOIN (UNPIVOT (SELECT count(COLUMNS(*)) AS "\\0" FROM lineitem) ON COLUMNS(*)
                               INTO NAME column_name VALUE n) USING (column_name)
GROUP BY 1""",

    "impute_mean": """
SELECT c_custkey, round(coalesce(CASE WHEN c_acctbal >= 0 THEN c_acctbal END,
                                 (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal >= 0)), 6) AS acctbal
FROM customer""",

    "impute_median": """
SELECT c_custkey, round(coalesce(CASE WHEN c_acctbal >= 0 THEN c_acctbal END,
                                 (SELECT median(c_acctbal) FROM customer WHERE c_acctbal >= 0)), 6) AS acctbal
FROM customer""",

    "value_density": f"""
WITH {MEASURES},
b AS (SELECT event_type AS g, log10(greatest(CAST(value AS DOUBLE), CAST(1 AS DOUBLE))) AS x FROM m WHERE value IS NOT NULL),
s AS (SELECT g, count(*) AS n, coalesce(stddev_samp(x), 0) AS sd, min(x) AS lo, max(x) AS hi,
             quantile_cont(x, CAST(0.75 AS DOUBLE)) - quantile_cont(x, CAST(0.25 AS DOUBLE)) AS iqr FROM b GROUP BY g),
l AS (SELECT *, CASE WHEN iqr > 0 THEN least(sd, iqr / CAST(1.34 AS DOUBLE)) ELSE sd END AS l0 FROM s),
w AS (SELECT g, n, lo, hi, CAST(0.9 AS DOUBLE) * pow(CAST(n AS DOUBLE), CAST(-0.2 AS DOUBLE))
             * (CASE WHEN l0 <> 0 THEN l0 WHEN sd <> 0 THEN sd WHEN iqr <> 0 THEN abs(iqr) ELSE 1 END) AS bw FROM l),
p AS (SELECT g, n, bw, lo - 3 * bw AS glo, ((hi + 3 * bw) - (lo - 3 * bw)) / 511 AS step FROM w),
a AS (SELECT b.g, CAST(floor((x - glo) / step) AS INTEGER) AS i, (x - glo) / step - floor((x - glo) / step) AS f FROM b JOIN p ON b.g = p.g),
n AS (SELECT g, i, sum(v) AS v FROM (SELECT g, i, 1 - f AS v FROM a UNION ALL SELECT g, i + 1, f FROM a)
      WHERE i BETWEEN 0 AND 511 GROUP BY g, i),
j AS (SELECT unnest(range(0, 512)) AS j)
SELECT p.g AS "group", round(any_value(glo + j * step), 6) AS x,
       round(sum(v * exp(CAST(-0.5 AS DOUBLE) * pow((j - i) * step / bw, 2))) / any_value(p.n * bw * sqrt(2 * pi())), 6) AS density
FROM n JOIN p ON p.g = n.g CROSS JOIN j GROUP BY p.g, j""",

    "missing_indicators": """
SELECT c_custkey, CAST(c_acctbal < 0 AS INTEGER) AS acctbal_missing FROM customer""",

    "split_exact": """
WITH h AS (SELECT c_custkey, md5('0:' || CAST(c_custkey AS VARCHAR)) AS h FROM customer)
SELECT c_custkey,
  CAST(row_number() OVER (ORDER BY h) <= (SELECT ceil(0.2 * count(*)) FROM customer) AS INTEGER) AS is_test
FROM h""",

    "stratified_folds": """
SELECT doc_id, quality,
  CAST((row_number() OVER (PARTITION BY quality ORDER BY md5('0:' || CAST(doc_id AS VARCHAR))) - 1) % 4 AS INTEGER)
    AS fold
FROM labels""",

    "class_weights": """
SELECT doc_id, quality,
  round(CASE WHEN quality = 1 THEN (SELECT sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END)
                                           / sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) FROM labels)
        ELSE 1.0 END, 6) AS weight
FROM labels""",

    "standardise": """
SELECT l_orderkey, l_linenumber,
  round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity,
  round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6) AS l_extendedprice,
  round((l_discount - avg(l_discount) OVER ()) / stddev_pop(l_discount) OVER (), 6) AS l_discount
FROM lineitem""",

    "roc_curve": f"""{_curve()}
SELECT round(threshold, 6) AS threshold, round(cn / "N", 6) AS fpr, round(cp / "P", 6) AS tpr FROM c""",

    "roc_corners_by_lang": f"""{_curve('lang')},
  k AS (SELECT *, lead(pos) OVER w AS np, lead(neg) OVER w AS nn, row_number() OVER w AS i
        FROM c WINDOW w AS (PARTITION BY lang ORDER BY threshold DESC))
SELECT lang, round(threshold, 6) AS threshold, round(cn / "N", 6) AS fpr, round(cp / "P", 6) AS tpr
FROM k WHERE i = 1 OR np IS NULL OR np <> pos OR nn <> neg
UNION ALL
SELECT DISTINCT lang, CAST('inf' AS DOUBLE), CASE WHEN "N" > 0 THEN 0.0 END, CASE WHEN "P" > 0 THEN 0.0 END FROM c""",

    "roc_auc_by_lang": f"""{_curve('lang')}
SELECT lang, round(sum(pos * ("N" - cn + 0.5 * neg)) / (first("P") * first("N")), 6) AS roc_auc
FROM c GROUP BY lang""",

    "pr_curve": f"""{_curve()}
SELECT round(threshold, 6) AS threshold, round(cp / (cp + cn), 6) AS precision, round(cp / "P", 6) AS recall FROM c""",

    "average_precision_by_lang": f"""{_curve('lang')}
SELECT lang, round(sum((pos / "P") * (cp / (cp + cn))), 6) AS average_precision FROM c GROUP BY lang""",

    "classification_report": _report_sql(),

    "kaplan_meier": _km_sql(),

    "concordance_index": f"""
WITH {SURVIVAL},
  pr AS (SELECT a.l_extendedprice AS si, b.l_extendedprice AS sj
         FROM f a JOIN f b ON a.event = 1 AND (b.days > a.days OR (b.days = a.days AND b.event = 0)))
SELECT round(sum(CASE WHEN sj < si THEN 1.0 WHEN sj = si THEN 0.5 ELSE 0.0 END)::DOUBLE / count(*), 6) AS cindex,
  sum(CASE WHEN sj < si THEN 1 ELSE 0 END)::DOUBLE AS concordant,
  sum(CASE WHEN sj > si THEN 1 ELSE 0 END)::DOUBLE AS discordant,
  sum(CASE WHEN sj = si THEN 1 ELSE 0 END)::DOUBLE AS tied_risk,
  count(*)::DOUBLE AS comparable
FROM pr""",

    "survival_window": f"""
WITH {SURVIVAL}
SELECT l_orderkey, l_linenumber, round(days, 6) AS days, CAST(event AS BOOLEAN) AS event
FROM f WHERE days > 0 AND days < 30""",

    "survival_histogram": f"""
WITH {SURVIVAL}
SELECT event, bin, count(*) AS n, round(bin * 10.0::DOUBLE, 6) AS bin_lo, round((bin + 1) * 10.0::DOUBLE, 6) AS bin_hi
FROM (SELECT event, CAST(least(floor(days / 10.0), 11) AS INTEGER) AS bin FROM f WHERE days >= 0 AND days <= 120)
GROUP BY event, bin""",

    "training_table": _training_sql(),

    # the leaves of a stump that separates the classes: all rows of a leaf have one label, so its sums are counts
    "boosted_separable": """
WITH RECURSIVE s AS (SELECT count(*) FILTER (WHERE l_quantity <= 24)::DOUBLE AS a, count(*) FILTER (WHERE l_quantity > 24)::DOUBLE AS b
                     FROM lineitem),
  step(k, ma, mb) AS (
    SELECT 0, ln(b / a), ln(b / a) FROM s
    UNION ALL
    SELECT k + 1, ma - 0.3 * a * pa / (a * pa * (1 - pa) + 1), mb + 0.3 * b * (1 - pb) / (b * pb * (1 - pb) + 1)
    FROM (SELECT k, ma, mb, 1 / (1 + exp(-ma)) AS pa, 1 / (1 + exp(-mb)) AS pb FROM step), s WHERE k < 8),
  p AS (SELECT 1 / (1 + exp(-ma)) AS pa, 1 / (1 + exp(-mb)) AS pb FROM step WHERE k = 8)
SELECT l_quantity, count(*) AS n, round(min(CASE WHEN l_quantity <= 24 THEN pa ELSE pb END), 5) AS min_score,
  round(max(CASE WHEN l_quantity <= 24 THEN pa ELSE pb END), 5) AS max_score,
  CAST(sum(CASE WHEN l_quantity > 24 THEN 1 ELSE 0 END) AS BIGINT) AS predicted
FROM lineitem, p GROUP BY l_quantity""",

    # Newton's steps for one slope and an intercept
    "elapsed_odds_ratio": f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT CAST(cdiff_30d_flag AS DOUBLE) AS y, CAST(admin_time_since_admission AS DOUBLE) AS x
                                  FROM ({_training_sql()}) WHERE cdiff_30d_flag IS NOT NULL AND admin_time_since_admission IS NOT NULL),
  step(k, b0, b1) AS (
    SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
    UNION ALL
    SELECT k + 1, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
    FROM (SELECT k, b0, b1, sum(y - p) AS g0, sum((y - p) * x) AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01,
                 sum(p * (1 - p) * x * x) AS h11
          FROM (SELECT k, b0, b1, x, y, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM step, t) GROUP BY k, b0, b1) WHERE k < 20)
SELECT 'admin_time_since_admission' AS feature, round(b1, 6) AS coef, round(b0, 6) AS intercept, round(exp(b1), 6) AS odds_ratio
FROM step WHERE k = 20""",

    # Newton's steps of the partial likelihood (Breslow ties): risk sets are running sums from the latest time down
    "cox_quantity": f"""
WITH RECURSIVE {SURVIVAL.replace("l.l_extendedprice", "l.l_quantity")},
  c AS MATERIALIZED (SELECT days, event, (l_quantity - (SELECT avg(l_quantity) FROM f)) / (SELECT stddev_pop(l_quantity) FROM f) AS x FROM f),
  step(k, b) AS (
    SELECT 0, 0.0::DOUBLE
    UNION ALL
    SELECT k + 1, b + sum(sx - d * s1 / s0) / sum(d * (s2 / s0 - (s1 / s0) * (s1 / s0)))
    FROM (SELECT k, b, d, sx, sum(r0) OVER w AS s0, sum(r1) OVER w AS s1, sum(r2) OVER w AS s2
          FROM (SELECT k, b, days, sum(event) AS d, sum(event * x) AS sx, sum(exp(b * x)) AS r0, sum(x * exp(b * x)) AS r1,
                       sum(x * x * exp(b * x)) AS r2
                FROM step, c WHERE k < 12 GROUP BY k, b, days)
          WINDOW w AS (ORDER BY days DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    GROUP BY k, b)
SELECT 'l_quantity' AS feature, round(b, 6) AS coef, round(exp(b), 6) AS hazard_ratio FROM step WHERE k = 12""",
}
