"""The cohort operators run on the shared test tables (TPC-H-like tables plus an
``events`` stream), with the clinical roles mapped as follows:

    index event            purchase events (key event_id, subject user_id)
    outcome test           error events with value > 100
    measurements + cutoffs view / click / signup events, cutoffs 100 / 150 / 80
    admission -> patient   orders -> customer
    drug lookup            parts of size <= 5 (part key -> part type)
    stay interval          order date .. + 30 days, containing the ship date
    survival               days from order to ship in (0, 120), event = return flag R
    label + score          labels.quality with documents.n_chars

Each entry has a Spark builder ``(spark, sf_dir) -> DataFrame`` and, where the
result is SQL-expressible, the equivalent DuckDB SQL over the same tables.
Floating outputs are rounded to 6 places on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.functions import columns as C
from cohortkit.operators import joins as J
from cohortkit.operators import labels as L
from cohortkit.operators import metrics as M
from cohortkit.operators import pivots as PV
from cohortkit.operators import prep as PR
from cohortkit.operators import summaries as SM
from cohortkit.operators import survival as SV
from cohortkit.operators.distribution import histogram, kde
from cohortkit.operators.history import STATS, history_stats, pivot_stats

# fixed parameters of the driver-table mapping
CUTOFFS = {"view": 100.0, "click": 150.0, "signup": 80.0}
TESTS = list(CUTOFFS)
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
FIRST_TYPES = ["click", "error", "purchase", "signup", "view"]
DOSE_CLASSES = ["high", "low", "mid"]
R6 = 6


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def _r(df: DataFrame) -> DataFrame:
    return C.round_cols(df, R6)


# ------------------------------------------------------------ shared frames
def purchases(spark, d):
    return _t(spark, d, "events").filter(F.col("event_type") == "purchase").select("user_id", "event_id", "ts")


def measures(spark, d):
    ev = _t(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return J.filter_by_threshold(ev, "event_type", "value", CUTOFFS)


def outcomes(spark, d):
    return (_t(spark, d, "events").filter((F.col("event_type") == "error") & (F.col("value") > 100))
            .select("user_id", F.col("ts").alias("test_ts")))


def history_long(spark, d, chunk_rows: int = 200_000):
    return history_stats(measures(spark, d), purchases(spark, d), ["user_id"], test_col="event_type",
                         time_col="ts", value_col="value", order_col="event_id", index_id="event_id",
                         index_time="ts", tests=TESTS, chunk_rows=chunk_rows)


def survival_frame(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag",
                                         "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    od = _t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return (li.join(od, "l_orderkey")
            .withColumn("days", C.days_between("o_orderdate", "l_shipdate"))
            .withColumn("event", C.flag(F.col("l_returnflag") == "R"))
            .transform(lambda x: C.filter_range(x, "days", 0, 120)))


def scored_docs(spark, d):
    lab = _t(spark, d, "labels").select("doc_id", "quality")
    doc = _t(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return lab.join(doc, "doc_id").withColumn("pred", (F.col("n_chars") >= 2000).cast("int"))


# ------------------------------------------------------------- Spark builders
def q_history_all_users(spark, d):
    """For each purchase, statistics of all earlier events of each type, whoever caused them: groups of whole event
    types, in chunks of 1,000 rows (more in large tables, see ``prefixstats``)."""
    out = history_stats(measures(spark, d), purchases(spark, d), [], test_col="event_type", time_col="ts", value_col="value",
                        order_col="event_id", index_id="event_id", index_time="ts", tests=TESTS, chunk_rows=1_000)
    # a mean of 32 amounts may end in 5 at the seventh place: nudged, so that it rounds alike whatever the order of the sum
    return _r(out.withColumn("mean", F.col("mean") + 1e-9))


def q_history_panel_stats(spark, d):
    return _r(history_long(spark, d))


def q_history_panel_wide(spark, d):
    return _r(pivot_stats(history_long(spark, d), ["user_id", "event_id"], "event_type", TESTS, STATS))


def q_group_summary(spark, d):
    ev = _t(spark, d, "events")
    return _r(SM.summarise(ev, ["user_id", "event_type"], "value", ["ts", "event_id"]))


def q_index_class_onehot(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    lookup = (_t(spark, d, "part").filter(F.col("p_size") <= 5)
              .select("p_partkey", F.split("p_type", " ").getItem(0).alias("p_class")))
    x = (J.semi_join(li, lookup, {"l_partkey": "p_partkey"})
         .withColumn("item_key", C.paste("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"))
         .transform(lambda df: J.lookup_join(df, lookup, {"l_partkey": "p_partkey"})))
    return PV.one_hot_pivot(x, ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "item_key"],
                            "p_class", PART_TYPES, prefix="class_is_")


def q_demographics_onehot(spark, d):
    od = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    cu = _t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    x = (J.enrich(od, cu.withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"])
         .withColumn("is_building", C.flag(F.col("c_mktsegment") == "BUILDING")))
    return PV.one_hot_pivot(x, ["o_orderkey", "o_custkey", "is_building"], "o_orderpriority", PRIORITIES,
                            prefix="prio_is_")


def q_outcome_tests(spark, d):
    ev = _t(spark, d, "events")
    x = C.filter_eq(ev, "event_type", "error")
    x = C.filter_range(x, "value", lo=100)
    x = C.rename(x, {"ts": "outcome_ts", "value": "outcome_value"})
    x = C.project(x, ["user_id", "event_id", "outcome_ts", "outcome_value"])
    return x.withColumn("outcome_ts", C.epoch_seconds("outcome_ts"))


def _label_inputs(spark, d):
    ev = _t(spark, d, "events")
    idx = purchases(spark, d).withColumnRenamed("ts", "t0")
    codes = (ev.filter((F.col("event_type") == "signup") & (F.col("value") > 300))
             .select("user_id").distinct().withColumn("code", F.lit("S300")))
    ends = ev.groupBy("user_id").agg(F.max("ts").alias("end_ts"))
    x = J.enrich(idx, outcomes(spark, d), ["user_id"])  # many-to-many: rows multiply
    x = J.enrich(x, codes, ["user_id"])
    return J.enrich(x, ends, ["user_id"])


def q_label_windows(spark, d):
    x = _label_inputs(spark, d)
    x = L.label_windows(x, "test_ts", "code", "S300", "end_ts", "t0", name="flag_{h}d")
    x = L.label_by_source(x, "test_ts", "code", "S300", "end_ts", "t0",
                          test_name="test_{h}d", code_name="code_{h}d")
    x = L.survival_target(x, "test_ts", "end_ts", "t0", label_col="flag_30d",
                          flag_name="surv_flag", time_name="surv_days")
    return _r(x.select("user_id", "event_id", C.epoch_seconds("test_ts").alias("test_time"),
                       *[f"flag_{h}d" for h in L.HORIZONS], *[f"test_{h}d" for h in L.HORIZONS],
                       *[f"code_{h}d" for h in L.HORIZONS], "surv_flag", "surv_days"))


def q_label_windows_as_executed(spark, d):
    x = _label_inputs(spark, d)
    x = L.label_windows(x, "test_ts", "code", "S300", "end_ts", "t0", as_executed=True, name="flag_{h}d")
    x = L.survival_target(x, "test_ts", "end_ts", "t0", event="test", flag_name="surv_flag",
                          time_name="surv_days")
    return _r(x.select("user_id", "event_id", *[f"flag_{h}d" for h in L.HORIZONS], "surv_flag", "surv_days"))


def q_composite_label(spark, d):
    ev = _t(spark, d, "events")
    diar = (ev.filter((F.col("event_type") == "click") & (F.col("value") > 400))
            .select("user_id").distinct().withColumn("dcode", F.lit("C400")))
    x = L.outcome_within(purchases(spark, d).withColumnRenamed("ts", "t0"), outcomes(spark, d), "user_id",
                         "t0", "test_ts", 30, name="has_test")
    x = J.enrich(x, diar, ["user_id"])
    return x.select("user_id", "event_id", F.coalesce(C.flag((F.col("has_test") == 1) & (F.col("dcode") == "C400")), F.lit(0))
                    .alias("composite_30d"))


def q_stay_interval(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    od = _t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    x = li.join(od, "l_orderkey").withColumn("stay_end", C.add_days("o_orderdate", 30))
    x = L.in_stay(x, "l_shipdate", "o_orderdate", "stay_end", name="in_stay")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "in_stay")


def q_elapsed_features(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    od = _t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    x = li.join(od, "l_orderkey")
    x = L.age_at(x, "o_orderdate", "l_shipdate", name="years")
    x = L.hours_since(x, "o_orderdate", "l_shipdate", name="hours")
    x = L.time_of_day(x, "o_orderdate", name="hour_of_day")
    x = L.qc_filter(x, age="years", elapsed="hours", max_age=5.0, max_hours=60 * 24)
    return _r(x.select("l_orderkey", "l_linenumber", "l_partkey", "years", "hours", "hour_of_day"))


def q_cardinality_check(spark, d):
    return J.check_cardinality(purchases(spark, d), outcomes(spark, d), ["user_id"])


def q_first_index_per_key(spark, d):
    p = purchases(spark, d)
    return p.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event_id"),
                                    F.count(F.lit(1)).alias("n_index"))


def q_dose_merge(spark, d):
    """Purchases of a user less than one hour apart merge into one administration."""
    from cohortkit.operators.sessions import merge_within

    s = merge_within(purchases(spark, d), "user_id", "ts", "event_id", 3600)
    return s.select("user_id", F.col("first_order").alias("first_event_id"), F.col("n_events").alias("doses"))


def q_prior_outcome_flag(spark, d):
    first = outcomes(spark, d).groupBy("user_id").agg(F.min("test_ts").alias("first_test"))
    x = J.enrich(purchases(spark, d), first, ["user_id"])
    return x.select("user_id", "event_id",
                    F.coalesce(C.flag(F.col("first_test") < F.col("ts")), F.lit(0)).alias("prior_outcome"))


def q_count_by_label(spark, d):
    return SM.count_by(_t(spark, d, "labels"), "quality")


def q_class_balance(spark, d):
    return _r(SM.class_balance(_t(spark, d, "labels"), "quality"))


def q_case_rate_by_lang(spark, d):
    return _r(SM.case_rate(scored_docs(spark, d), "quality", ["lang"]))


def q_schema_profile(spark, d):
    return SM.schema_profile(_t(spark, d, "lineitem"))


def _acct(spark, d):
    cu = _t(spark, d, "customer")
    return cu.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("acctbal"))


def q_impute_mean(spark, d):
    return _r(PR.impute_mean(_acct(spark, d), ["acctbal"]))


def q_impute_median(spark, d):
    return _r(PR.impute_median(_acct(spark, d), ["acctbal"]))


def q_missing_indicators(spark, d):
    a = _acct(spark, d)
    return a.select("c_custkey", F.col("acctbal").isNull().cast("int").alias("acctbal_missing"))


def q_split_exact(spark, d):
    cu = _t(spark, d, "customer").select("c_custkey")
    return PR.split_exact(cu, ["c_custkey"], 0.2, seed=0)


def q_stratified_folds(spark, d):
    lab = _t(spark, d, "labels").select("doc_id", "quality")
    return PR.stratified_folds(lab, ["doc_id"], "quality", k=4, seed=0)


def q_class_weights(spark, d):
    lab = _t(spark, d, "labels").select("doc_id", "quality")
    return _r(PR.class_weights(lab, "quality"))


def q_standardise(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                         "l_discount")
    return _r(PR.standardise(li, ["l_quantity", "l_extendedprice", "l_discount"]))


def q_roc_curve(spark, d):
    return _r(M.roc_curve(scored_docs(spark, d), "quality", "n_chars"))


def q_roc_corners_by_lang(spark, d):
    """Curve points as the reference's library returns them: no collinear points, (0, 0) first."""
    return _r(M.roc_curve(scored_docs(spark, d), "quality", "n_chars", ["lang"], drop_intermediate=True, start=True))


def q_roc_auc_by_lang(spark, d):
    return _r(M.roc_auc(scored_docs(spark, d), "quality", "n_chars", ["lang"]))


def q_pr_curve(spark, d):
    return _r(M.pr_curve(scored_docs(spark, d), "quality", "n_chars"))


def q_average_precision_by_lang(spark, d):
    return _r(M.average_precision(scored_docs(spark, d), "quality", "n_chars", ["lang"]))


def q_classification_report(spark, d):
    return _r(M.classification_report(scored_docs(spark, d), "quality", "pred", ["lang"]))


def q_kaplan_meier(spark, d):
    return _r(SV.kaplan_meier(survival_frame(spark, d), "days", "event"))


def q_concordance_index(spark, d):
    return _r(SV.concordance_index(survival_frame(spark, d), "days", "event", "l_extendedprice"))


def q_survival_window(spark, d):
    s = survival_frame(spark, d)
    return _r(SV.survival_window(s, "days", "event", 0, 30).select("l_orderkey", "l_linenumber", "days", "event"))


def q_survival_histogram(spark, d):
    return histogram(survival_frame(spark, d), "days", 0, 120, 12, ["event"]).select(
        "event", "bin", "n", F.round("bin_lo", 6).alias("bin_lo"), F.round("bin_hi", 6).alias("bin_hi"))


COX_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


def q_cox_hazard_ratios(spark, d):
    s = survival_frame(spark, d)
    model = SV.fit_cox(s, COX_FEATURES, "days", "event", standardize=True)
    return _r(SV.hazard_ratios(spark, model))


def q_cox_quantity(spark, d):
    """One standardised covariate, so that SQL can follow Newton's steps."""
    model = SV.fit_cox(survival_frame(spark, d), ["l_quantity"], "days", "event", standardize=True)
    return _r(SV.hazard_ratios(spark, model))


def q_cox_concordance(spark, d):
    s = survival_frame(spark, d)
    model = SV.fit_cox(s, COX_FEATURES, "days", "event", standardize=True)
    scored = SV.cox_predict(model, s)
    return _r(SV.concordance_index(scored, "days", "event", "risk_score"))


def q_value_density(spark, d):
    return _r(kde(measures(spark, d), "value", "event_type", log10=True, floor=1.0))


# ------------------------------------------------------------ the full table
def training_frames(spark, d):
    """The seven inputs of ``build_training_table`` derived from the test tables."""
    ev = _t(spark, d, "events")
    p = ev.filter(F.col("event_type") == "purchase")
    idx0 = (p.select(F.col("user_id").alias("subject_id"), F.col("user_id").alias("hadm_id"),
                     F.col("user_id").alias("icustay_id"), "event_id",
                     F.col("ts").alias("ab_startdate"), C.add_days("ts", 1).alias("ab_enddate"),
                     F.when(F.col("value") < 100, "low").when(F.col("value") < 250, "mid").otherwise("high")
                     .alias("dose_class"))
            .withColumn("antibiotic_key", C.paste("subject_id", "hadm_id", "icustay_id", "event_id",
                                                  F.lit("purchase"))))
    index = PV.one_hot_pivot(idx0, ["subject_id", "hadm_id", "icustay_id", "antibiotic_key", "ab_startdate",
                                    "ab_enddate"], "dose_class", DOSE_CLASSES, prefix="ab_class_is_")
    tests = (ev.filter((F.col("event_type") == "error") & (F.col("value") > 100))
             .select(F.col("user_id").alias("subject_id"), F.col("user_id").alias("hadm_id"),
                     F.col("ts").alias("cdiff_charttime"), F.lit(80139).cast("long").alias("org_itemid")))
    codes = (ev.filter((F.col("event_type") == "signup") & (F.col("value") > 300))
             .select(F.col("user_id").alias("subject_id")).distinct()
             .select("subject_id", F.col("subject_id").alias("hadm_id"), F.lit("00845").alias("cdiff_icd9")))
    diar = (ev.filter((F.col("event_type") == "click") & (F.col("value") > 400))
            .select(F.col("user_id").alias("subject_id")).distinct()
            .select("subject_id", F.col("subject_id").alias("hadm_id"), F.lit("78791").alias("diarrhea_icd9")))
    users = ev.groupBy("user_id").agg(
        F.min("ts").alias("admittime"), F.max("ts").alias("dischtime"),
        F.min_by("event_type", F.struct("ts", "event_id")).alias("admission_type"),
        F.max((F.col("event_type") == "view") & (F.col("value") > 200)).alias("_f"))
    demo0 = users.select(F.col("user_id").alias("subject_id"), F.col("user_id").alias("hadm_id"),
                         C.flag(F.col("_f")).alias("is_female"),
                         (F.col("admittime").cast("timestamp")
                          - F.make_dt_interval((F.col("user_id") * 250).cast("int"))).alias("dob"),
                         "admittime", "dischtime", "admission_type")
    demo = PV.one_hot_pivot(demo0, ["subject_id", "hadm_id", "is_female", "dob", "admittime", "dischtime"],
                            "admission_type", FIRST_TYPES, prefix="admit_is_")
    icu = users.select(F.col("user_id").alias("subject_id"), F.col("user_id").alias("hadm_id"),
                       F.col("user_id").alias("icustay_id"), F.col("admittime").alias("icu_intime"),
                       C.add_days("admittime", 7).alias("icu_outtime"))
    meas = measures(spark, d).select(F.col("user_id").alias("subject_id"), F.col("user_id").alias("hadm_id"),
                                     "event_type", "ts", "event_id", "value")
    # the pre-pivot rows carry the same unique keys; using them skips the pivot's shuffle here
    long = history_stats(meas, idx0.select("subject_id", "hadm_id", "antibiotic_key", "ab_startdate"),
                         ["subject_id", "hadm_id"], test_col="event_type", time_col="ts", value_col="value",
                         order_col="event_id", index_id="antibiotic_key", index_time="ab_startdate", tests=TESTS)
    feats = pivot_stats(long, ["subject_id", "hadm_id", "antibiotic_key"], "event_type", TESTS, STATS)
    return index, tests, codes, diar, demo, icu, feats


def q_training_table(spark, d):
    from cohortkit.plans.cohort import build_training_table

    return _r(build_training_table(*training_frames(spark, d)))


SPARK = {
    "history_all_users": q_history_all_users,
    "history_panel_stats": q_history_panel_stats,
    "history_panel_wide": q_history_panel_wide,
    "group_summary": q_group_summary,
    "index_class_onehot": q_index_class_onehot,
    "demographics_onehot": q_demographics_onehot,
    "outcome_tests": q_outcome_tests,
    "label_windows": q_label_windows,
    "label_windows_as_executed": q_label_windows_as_executed,
    "composite_label": q_composite_label,
    "stay_interval": q_stay_interval,
    "elapsed_features": q_elapsed_features,
    "cardinality_check": q_cardinality_check,
    "first_index_per_key": q_first_index_per_key,
    "dose_merge": q_dose_merge,
    "prior_outcome_flag": q_prior_outcome_flag,
    "count_by_label": q_count_by_label,
    "class_balance": q_class_balance,
    "case_rate_by_lang": q_case_rate_by_lang,
    "schema_profile": q_schema_profile,
    "impute_mean": q_impute_mean,
    "impute_median": q_impute_median,
    "missing_indicators": q_missing_indicators,
    "split_exact": q_split_exact,
    "stratified_folds": q_stratified_folds,
    "class_weights": q_class_weights,
    "standardise": q_standardise,
    "roc_curve": q_roc_curve,
    "roc_corners_by_lang": q_roc_corners_by_lang,
    "roc_auc_by_lang": q_roc_auc_by_lang,
    "pr_curve": q_pr_curve,
    "average_precision_by_lang": q_average_precision_by_lang,
    "classification_report": q_classification_report,
    "kaplan_meier": q_kaplan_meier,
    "concordance_index": q_concordance_index,
    "survival_window": q_survival_window,
    "survival_histogram": q_survival_histogram,
    "cox_hazard_ratios": q_cox_hazard_ratios,
    "cox_quantity": q_cox_quantity,
    "cox_concordance": q_cox_concordance,
    "value_density": q_value_density,
    "training_table": q_training_table,
}


# ------------------------------------------------- modelling on the cohort table
def _cohort_with_keys(spark, d):
    from cohortkit.plans.cohort import build_training_table

    t = build_training_table(*training_frames(spark, d), drop_roles=False)
    return t.withColumn("row_key", C.paste("antibiotic_key", C.epoch_micros("cdiff_charttime")))


def _feature_cols(t: DataFrame) -> list:
    from cohortkit.plans.cohort import Roles

    return [c for c in Roles().features(t) if c not in ("row_key",)]


def q_boosted_horizon_eval(spark, d):
    """Reference grid (32 points) and 4 stratified folds, a model per horizon."""
    from cohortkit.plans.modelling import develop

    t = _cohort_with_keys(spark, d)
    m = develop(t, _feature_cols(t), ["row_key"])["metrics"]
    return _r(m["roc_auc"].join(m["average_precision"], "horizon"))


BOOST_FEATURES = ["l_discount", "l_quantity", "l_tax"]


def q_boosted_separable(spark, d):
    """Eight boosted stumps on a label that one of three features separates: per quantity its rows, score and predicted
    positives.  Both leaves of such stumps are known, so SQL follows the boosting step by step."""
    from cohortkit.operators import boosting as BO

    li = _t(spark, d, "lineitem").select(*BOOST_FEATURES, C.flag(F.col("l_quantity") > 24).alias("label"))
    x = PR.assemble(li, BOOST_FEATURES)
    binned = BO.bin_rows(x, [("label", None, None)], max_bins=255)
    model, = BO.refit(binned, [{"maxIter": 8, "maxDepth": 1, "stepSize": 0.3}])
    scored = BO.predict(model, x)
    return C.round_cols(scored.groupBy("l_quantity").agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("min_score"), F.max("score").alias("max_score"),
        F.sum("prediction").alias("predicted")), 5)


def q_split_importance(spark, d):
    """Splits per feature in the 30-day model that the reference grid chooses."""
    from cohortkit.operators import boosting as BO
    from cohortkit.plans.modelling import develop

    t = _cohort_with_keys(spark, d)
    feats = _feature_cols(t)
    res = develop(t, feats, ["row_key"], horizons=(30,))
    return BO.split_count_importance(res["models"][30], spark, [f for f in feats if f not in res["dropped"]], k=30)


def q_cox_cohort_study(spark, d):
    from cohortkit.plans.modelling import survival_study

    res = survival_study(_cohort_with_keys(spark, d), ["row_key"])
    return _r(res["cindex"])


def q_elapsed_odds_ratio(spark, d):
    from cohortkit.plans.modelling import odds_ratio

    return _r(odds_ratio(_cohort_with_keys(spark, d), "cdiff_30d_flag", "admin_time_since_admission"))


SPARK.update({
    "boosted_horizon_eval": q_boosted_horizon_eval,
    "boosted_separable": q_boosted_separable,
    "split_importance": q_split_importance,
    "cox_cohort_study": q_cox_cohort_study,
    "elapsed_odds_ratio": q_elapsed_odds_ratio,
})
