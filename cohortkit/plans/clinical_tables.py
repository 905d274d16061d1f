"""Steps C1-C5, prior-visit flags and a top-k report on the shared test tables, renamed to the
clinical columns, with their DuckDB SQL.

    prescriptions      lineitem: drug = part key, stay id NULL for odd line numbers, lookup = parts of size <= 5
    microbiology       events: ``error`` above 100 is the outcome organism, anything else organism 1
    diagnoses          events: ``signup`` above 300 and ``click`` above 400 carry the two codes
    admissions         orders; patients: customer
    ICU stays          first and last event of each user
    lab measurements   events by type; every third user has no admission id (a NULL key on both sides)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.functions import columns as C
from cohortkit.operators import labels as L
from cohortkit.operators import summaries as SM
from cohortkit.operators.history import STATS
from cohortkit.plans import cohort as CO
from cohortkit.plans.driver_tables import PART_TYPES, PRIORITIES, purchases

LABS = {"click": "alkaline_phosphatase", "error": "bilirubin_total", "signup": "platelets",
        "view": "alanine_transaminase"}
ITEMS = {t: i for tests in CO.PANELS.values() for t, i in tests.items()}
PRIOR_CODES = ["C400", "S300", "V200"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def _third_null(c: str) -> F.Column:
    return F.when(F.col(c) % 3 != 0, F.col(c))


def q_clinical_index_events(spark, d):
    rx = _t(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("subject_id"), F.col("l_orderkey").alias("hadm_id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey")).alias("icustay_id"),
        F.col("l_linenumber").alias("row_id"), F.col("l_partkey").cast("string").alias("drug"),
        F.col("l_shipdate").alias("startdate"), C.add_days("l_shipdate", 2).alias("enddate"))
    lookup = (_t(spark, d, "part").filter(F.col("p_size") <= 5)
              .select(F.col("p_partkey").cast("string").alias("Antibiotic"),
                      F.split("p_type", " ").getItem(0).alias("drug_class")))
    x = CO.index_events(rx, lookup, classes=PART_TYPES)
    return x.withColumns({c: C.epoch_seconds(c) for c in ("ab_startdate", "ab_enddate")})


def q_clinical_outcome_tests(spark, d):
    micro = _t(spark, d, "events").select(
        F.col("user_id").alias("subject_id"), _third_null("user_id").alias("hadm_id"), F.col("ts").alias("charttime"),
        F.when((F.col("event_type") == "error") & (F.col("value") > 100), CO.OUTCOME_ORGANISM).otherwise(1)
        .alias("org_itemid"))
    return CO.outcome_tests(micro).withColumn("cdiff_charttime", C.epoch_seconds("cdiff_charttime"))


def q_clinical_code_events(spark, d):
    e = _t(spark, d, "events")
    dx = e.select(F.col("user_id").alias("subject_id"), _third_null("user_id").alias("hadm_id"), C.case_first(
        [((F.col("event_type") == "signup") & (F.col("value") > 300), F.lit(CO.OUTCOME_CODE)),
         ((F.col("event_type") == "click") & (F.col("value") > 400), F.lit(CO.DIARRHOEA_CODE))]).alias("icd9_code"))
    return (CO.code_events(dx, CO.OUTCOME_CODE, "code")
            .unionByName(CO.code_events(dx, CO.DIARRHOEA_CODE, "code")))


def q_clinical_demographics(spark, d):
    adm = _t(spark, d, "orders").select(
        F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"),
        F.col("o_orderdate").alias("admittime"), C.add_days("o_orderdate", 7).alias("dischtime"),
        F.col("o_orderpriority").alias("admission_type"))
    pat = _t(spark, d, "customer").select(
        F.col("c_custkey").alias("subject_id"),
        C.case_first([(F.col("c_mktsegment") == "BUILDING", F.lit("F")), (F.col("c_mktsegment") != "MACHINERY", F.lit("M"))])
        .alias("gender"), F.timestamp_seconds(F.col("c_custkey") * 86400).alias("dob"))
    x = CO.demographics(adm, pat, admission_types=PRIORITIES)
    return x.withColumns({c: C.epoch_seconds(c) for c in ("dob", "admittime", "dischtime")})


def q_clinical_stays(spark, d):
    icu = (_t(spark, d, "events").groupBy(F.col("user_id").alias("subject_id"))
           .agg(F.min("ts").alias("intime"), F.max("ts").alias("outtime"))
           .withColumns({"hadm_id": _third_null("subject_id"), "icustay_id": F.col("subject_id") + 1000}))
    return CO.stays(icu).withColumns({c: C.epoch_seconds(c) for c in ("icu_intime", "icu_outtime")})


def q_clinical_panel_features(spark, d):
    e = _t(spark, d, "events")
    labs = e.select(F.col("user_id").alias("subject_id"), _third_null("user_id").alias("hadm_id"),
                    C.map_codes("event_type", {k: ITEMS[t] for k, t in LABS.items()}).cast("long").alias("itemid"),
                    F.col("ts").alias("charttime"), F.col("event_id").alias("row_id"), F.col("value").alias("valuenum"))
    index = purchases(spark, d).select(
        F.col("user_id").alias("subject_id"), _third_null("user_id").alias("hadm_id"),
        F.col("event_id").alias("antibiotic_key"), F.col("ts").alias("ab_startdate"))
    panels = CO.panel_frame(spark, {"labs": {t: ITEMS[t] for t in sorted(LABS.values())}})
    return C.round_cols(CO.panel_features(labs, index, panels), 6)


def q_prior_code_flags(spark, d):
    """Which codes a user had before each purchase (prior-visit comorbidity)."""
    e = _t(spark, d, "events")
    codes = e.select("user_id", "ts", C.case_first(
        [((F.col("event_type") == "click") & (F.col("value") > 400), F.lit("C400")),
         ((F.col("event_type") == "signup") & (F.col("value") > 300), F.lit("S300")),
         ((F.col("event_type") == "view") & (F.col("value") > 200), F.lit("V200"))]).alias("code"))
    x = L.prior_code_flags(purchases(spark, d), codes.filter(F.col("code").isNotNull()), ["user_id"], "ts", "ts", "code",
                           PRIOR_CODES, prefix="prior_")
    return x.select("user_id", "event_id", *[f"prior_{c}" for c in PRIOR_CODES])


def q_top_parts(spark, d):
    """The 20 parts sold most often."""
    n = _t(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return SM.top_k(n, "n", 20, ties=["l_partkey"])


SPARK = {
    "clinical_index_events": q_clinical_index_events,
    "clinical_outcome_tests": q_clinical_outcome_tests,
    "clinical_code_events": q_clinical_code_events,
    "clinical_demographics": q_clinical_demographics,
    "clinical_stays": q_clinical_stays,
    "clinical_panel_features": q_clinical_panel_features,
    "prior_code_flags": q_prior_code_flags,
    "top_parts": q_top_parts,
}

_HADM = "CASE WHEN user_id % 3 <> 0 THEN user_id END"
_LAB_ROWS = ", ".join(f"('{k}', '{t}', {CO.THRESHOLDS_INTENDED[t]})" for k, t in LABS.items())
_STAT_SQL = {
    "mean": "avg(v)", "median": "median(v)", "max": "max(v)", "min": "min(v)", "range": "max(v) - min(v)",
    "sd": "coalesce(stddev_samp(v), 0)", "iqr": "quantile_cont(v, 0.75) - quantile_cont(v, 0.25)",
    "first": "arg_min(v, (ts, event_id))", "last": "arg_max(v, (ts, event_id))", "count": "count(*)"}
_WIDE = ",\n  ".join(
    f"max(CASE WHEN test = '{t}' THEN {'round(s_' + s + ', 6)' if s != 'count' else 's_count'} END) AS \"{s}_{t}\""
    for t in sorted(LABS.values()) for s in STATS)


def _one_hot(col: str, values, prefix: str) -> str:
    return ", ".join(f"coalesce(max(CASE WHEN {col} = '{v}' THEN 1 END), 0) AS \"{prefix}{v}\"" for v in values)


ORACLE = {
    "clinical_index_events": f"""
WITH x AS (
  SELECT l.l_suppkey AS subject_id, l.l_orderkey AS hadm_id,
    CASE WHEN l.l_linenumber % 2 = 0 THEN l.l_orderkey END AS icustay_id,
    concat_ws('_', l.l_suppkey, l.l_orderkey, CASE WHEN l.l_linenumber % 2 = 0 THEN CAST(l.l_orderkey AS VARCHAR) ELSE 'NA' END,
              l.l_linenumber, l.l_partkey) AS antibiotic_key,
    epoch_us(l.l_shipdate) / 1000000.0 AS ab_startdate, epoch_us(l.l_shipdate + INTERVAL 2 DAY) / 1000000.0 AS ab_enddate,
    split_part(p.p_type, ' ', 1) AS c
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_size <= 5)
SELECT subject_id, hadm_id, icustay_id, antibiotic_key, ab_startdate, ab_enddate, {_one_hot('c', PART_TYPES, 'ab_class_is_')}
FROM x GROUP BY subject_id, hadm_id, icustay_id, antibiotic_key, ab_startdate, ab_enddate""",

    "clinical_outcome_tests": f"""
SELECT user_id AS subject_id, {_HADM} AS hadm_id, epoch_us(ts) / 1000000.0 AS cdiff_charttime,
  CAST({CO.OUTCOME_ORGANISM} AS INTEGER) AS org_itemid
FROM events WHERE event_type = 'error' AND value > 100""",

    "clinical_code_events": f"""
SELECT user_id AS subject_id, {_HADM} AS hadm_id,
  CASE WHEN event_type = 'signup' THEN '{CO.OUTCOME_CODE}' ELSE '{CO.DIARRHOEA_CODE}' END AS code
FROM events WHERE (event_type = 'signup' AND value > 300) OR (event_type = 'click' AND value > 400)""",

    "clinical_demographics": f"""
WITH x AS (
  SELECT o.o_custkey AS subject_id, o.o_orderkey AS hadm_id,
    CASE c.c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN NULL ELSE 0 END AS is_female,
    CAST(c.c_custkey * 86400 AS DOUBLE) AS dob, epoch_us(o.o_orderdate) / 1000000.0 AS admittime,
    epoch_us(o.o_orderdate + INTERVAL 7 DAY) / 1000000.0 AS dischtime, o.o_orderpriority AS p
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey)
SELECT subject_id, hadm_id, CAST(is_female AS INTEGER) AS is_female, dob, admittime, dischtime,
  {_one_hot('p', PRIORITIES, 'admit_is_')}
FROM x GROUP BY subject_id, hadm_id, is_female, dob, admittime, dischtime""",

    "clinical_stays": f"""
SELECT user_id AS subject_id, {_HADM} AS hadm_id, user_id + 1000 AS icustay_id,
  epoch_us(min(ts)) / 1000000.0 AS icu_intime, epoch_us(max(ts)) / 1000000.0 AS icu_outtime
FROM events GROUP BY user_id""",

    "clinical_panel_features": f"""
WITH m AS (SELECT e.user_id, e.event_id, e.ts, e.value AS v, c.test
           FROM events e JOIN (VALUES {_LAB_ROWS}) AS c(event_type, test, cutoff) ON e.event_type = c.event_type
           WHERE e.value < c.cutoff),
  h AS (SELECT i.user_id, i.event_id, m.test, {", ".join(f"{q} AS s_{s}" for s, q in
            ((s, q.replace('(v', '(m.v').replace('(ts, event_id)', '(m.ts, m.event_id)')) for s, q in _STAT_SQL.items()))}
        FROM events i JOIN m ON i.user_id = m.user_id AND m.ts < i.ts WHERE i.event_type = 'purchase'
        GROUP BY i.user_id, i.event_id, m.test)
SELECT user_id AS subject_id, {_HADM} AS hadm_id, event_id AS antibiotic_key,
  {_WIDE}
FROM h GROUP BY user_id, event_id""",

    "prior_code_flags": f"""
WITH c AS (SELECT user_id, ts, CASE event_type WHEN 'click' THEN 'C400' WHEN 'signup' THEN 'S300' ELSE 'V200' END AS code
           FROM events WHERE (event_type = 'click' AND value > 400) OR (event_type = 'signup' AND value > 300)
             OR (event_type = 'view' AND value > 200))
SELECT p.user_id, p.event_id, {", ".join(
    f"CAST(EXISTS (SELECT 1 FROM c WHERE c.user_id = p.user_id AND c.ts < p.ts AND c.code = '{k}') AS INTEGER) AS prior_{k}"
    for k in PRIOR_CODES)}
FROM events p WHERE p.event_type = 'purchase'""",

    "top_parts": """
SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 20""",
}
