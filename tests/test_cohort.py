import datetime as dt

from pyspark.sql import functions as F

from cohortkit.operators.joins import check_cardinality, enrich, filter_by_threshold
from cohortkit.plans import cohort as CO

T0 = dt.datetime(2030, 6, 1)
D = dt.timedelta(days=1)


def fixtures(spark):
    lookup = spark.createDataFrame([("Vancomycin", "Glycopeptide"), ("Ampicillin", "Penicillin"),
                                    ("Amoxicillin", "Penicillin")], "Antibiotic string, drug_class string")
    rx = spark.createDataFrame([
        (1, 100, 1000, None, T0, T0 + 3 * D, "Vancomycin"),
        (2, 100, 1000, None, T0 + D, T0 + 3 * D, "Ampicillin"),
        (3, 101, 1001, 5001, T0, T0 + D, "Ampicillin"),
        (4, 101, 1001, 5001, T0, T0 + D, "Aspirin"),  # not an antibiotic
    ], "row_id long, subject_id long, hadm_id long, icustay_id long, startdate timestamp, enddate timestamp, "
       "drug string")
    micro = spark.createDataFrame([
        (100, 1000, T0 + 2 * D, 80139), (100, 1000, T0 + 20 * D, 80139), (101, 1001, T0 + D, 11111),
    ], "subject_id long, hadm_id long, charttime timestamp, org_itemid long")
    dx = spark.createDataFrame([
        (1, 100, 1000, 1, "00845"), (2, 101, 1001, 1, "78791"), (3, 101, 1001, 2, "4019"),
    ], "row_id long, subject_id long, hadm_id long, seq_num long, icd9_code string")
    adm = spark.createDataFrame([
        (100, 1000, T0 - 2 * D + dt.timedelta(hours=9), T0 + 5 * D, "EMERGENCY", "Medicare", "SEPSIS"),
        (101, 1001, T0 - D, T0 + 40 * D, "ELECTIVE", "Private", "X"),
    ], "subject_id long, hadm_id long, admittime timestamp, dischtime timestamp, admission_type string, "
       "insurance string, diagnosis string")
    pat = spark.createDataFrame([(100, "F", dt.datetime(1960, 1, 1)), (101, "M", dt.datetime(1950, 1, 1))],
                                "subject_id long, gender string, dob timestamp")
    icu = spark.createDataFrame([(100, 1000, None, T0 - D, T0 + D), (101, 1001, 5001, T0 - D, T0 + D)],
                                "subject_id long, hadm_id long, icustay_id long, intime timestamp, outtime timestamp")
    labs = spark.createDataFrame([
        (1, 100, 1000, 50861, T0 - D, "x", 30.0, "u", None),     # ALT 30: kept as intended (<100), not as executed (<20)
        (2, 100, 1000, 50885, T0 - D, "x", 25.0, "u", None),     # bilirubin 25: dropped intended (<20), kept executed (<100)
        (3, 100, 1000, 50912, T0 - 2 * D, "x", 1.1, "u", None),  # creatinine
        (4, 100, 1000, 50912, T0 - D, "x", 1.3, "u", None),
        (5, 100, 1000, 50912, T0 + 2 * D, "x", 9.0, "u", None),  # after every index: never used
        (6, 101, 1001, 51222, T0 - D, "x", 12.0, "u", None),
    ], "row_id long, subject_id long, hadm_id long, itemid long, charttime timestamp, value string, "
       "valuenum double, valueuom string, flag string")
    return lookup, rx, micro, dx, adm, pat, icu, labs


def test_index_events_and_demographics(spark):
    lookup, rx, micro, dx, adm, pat, icu, labs = fixtures(spark)
    idx = CO.index_events(rx, lookup)
    rows = {r["antibiotic_key"]: r for r in idx.collect()}
    assert set(rows) == {"100_1000_NA_1_Vancomycin", "100_1000_NA_2_Ampicillin", "101_1001_5001_3_Ampicillin"}
    assert rows["100_1000_NA_1_Vancomycin"]["ab_class_is_Glycopeptide"] == 1
    assert rows["100_1000_NA_1_Vancomycin"]["ab_class_is_Penicillin"] == 0
    demo = {r["subject_id"]: r for r in CO.demographics(adm, pat).collect()}
    assert demo[100]["is_female"] == 1 and demo[100]["admit_is_EMERGENCY"] == 1 and demo[100]["admit_is_ELECTIVE"] == 0
    assert "insurance" not in CO.demographics(adm, pat).columns


def test_thresholds_by_name_not_position(spark):
    *_, labs = fixtures(spark)
    intended = CO.panel_frame(spark, thresholds=CO.THRESHOLDS_INTENDED)
    executed = CO.panel_frame(spark, thresholds=CO.THRESHOLDS_AS_EXECUTED)

    def kept(p):
        q = labs.join(p.select("itemid", "test_name", "cutoff"), "itemid").filter(F.col("valuenum") < F.col("cutoff"))
        return {r["test_name"] for r in q.collect()}

    assert "alanine_transaminase" in kept(intended) and "bilirubin_total" not in kept(intended)
    assert "alanine_transaminase" not in kept(executed) and "bilirubin_total" in kept(executed)
    try:
        CO.panel_frame(spark, thresholds={"bilirubin_total": 1})
        raise AssertionError("a test without a threshold must raise")
    except KeyError:
        pass
    f = filter_by_threshold(spark.createDataFrame([("a", 1.0), ("a", 5.0), ("b", 1.0)], "k string, v double"),
                            "k", "v", {"a": 2.0})
    assert [tuple(r) for r in f.collect()] == [("a", 1.0)]


def test_build_training_table_end_to_end(spark):
    lookup, rx, micro, dx, adm, pat, icu, labs = fixtures(spark)
    idx = CO.index_events(rx, lookup)
    tests = CO.outcome_tests(micro)
    codes = CO.code_events(dx, CO.OUTCOME_CODE, "cdiff_icd9")
    diar = CO.code_events(dx, CO.DIARRHOEA_CODE, "diarrhea_icd9")
    feats = CO.panel_features(labs, idx, CO.panel_frame(spark))
    out = CO.build_training_table(idx, tests, codes, diar, CO.demographics(adm, pat), CO.stays(icu), feats,
                                  drop_roles=False)
    rows = out.collect()
    # admission 1000 has two index events x two outcome tests = 4 rows (many-to-many kept, T6)
    assert sum(1 for r in rows if r["hadm_id"] == 1000) == 4
    r = [x for x in rows if x["antibiotic_key"] == "100_1000_NA_1_Vancomycin"
         and x["cdiff_charttime"] == T0 + 2 * D][0]
    assert r["cdiff_2d_flag"] == 1 and r["cdiff_label_elisa_2d"] == 1 and r["cdiff_label_icd9_2d"] == 0
    assert r["count_creatinine"] == 2 and abs(r["mean_creatinine"] - 1.2) < 1e-12
    assert r["mean_alanine_transaminase"] == 30.0 and r["mean_bilirubin_total"] is None
    assert r["in_icu"] == 1  # NULL stay id matched by the null-safe join; the stay contains the start
    assert r["admin_time_since_admission"] == 48.0
    r2 = [x for x in rows if x["antibiotic_key"] == "100_1000_NA_1_Vancomycin"
          and x["cdiff_charttime"] == T0 + 20 * D][0]
    assert r2["cdiff_2d_flag"] == 0 and r2["cdiff_30d_flag"] == 1
    assert abs(r2["survival_time"] - 20) < 1e-12
    dropped = CO.build_training_table(idx, tests, codes, diar, CO.demographics(adm, pat), CO.stays(icu), feats)
    assert "antibiotic_key" not in dropped.columns and "dob" not in dropped.columns
    assert dropped.count() == len(rows)


def test_lag_and_survival_window(spark):
    """An outcome test at the start itself counts without a lag only; the survival event is its window's label."""
    lookup, rx, micro, dx, adm, pat, icu, labs = fixtures(spark)
    idx = CO.index_events(rx, lookup)
    at_start = idx.select("subject_id", "hadm_id", F.col("ab_startdate").cast("timestamp").alias("cdiff_charttime")).limit(1)
    rest = (CO.code_events(dx, CO.OUTCOME_CODE, "cdiff_icd9").limit(0), CO.code_events(dx, CO.DIARRHOEA_CODE, "diarrhea_icd9"),
            CO.demographics(adm, pat), CO.stays(icu), CO.panel_features(labs, idx, CO.panel_frame(spark)))

    def flags(**kw):
        t = CO.build_training_table(idx, at_start, *rest, drop_roles=False, **kw)
        t = t.filter(F.col("cdiff_charttime") == F.col("ab_startdate").cast("timestamp"))
        return {tuple(r) for r in t.select("cdiff_7d_flag", "cdiff_label_elisa_7d", "cdiff_survival_flag", "survival_time").collect()}

    late, now = flags(survival_days=7), flags(survival_days=7, lag=0)
    assert {r[:3] for r in late} == {(0, 0, 0)} and all(r[3] > 0 for r in late)
    assert now == {(1, 1, 1, 0.0)}


def test_cardinality_and_null_safe_enrich(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, 5)], "k long, s long")
    b = spark.createDataFrame([(1, None, "x"), (1, None, "y"), (2, 5, "z")], "k long, s long, v string")
    card = check_cardinality(a, b, ["k"]).first()
    assert card["relationship"] == "many-to-many" and card["joined_rows"] == 5
    assert enrich(a, b, ["k", "s"], null_safe=True).filter(F.col("v").isNotNull()).count() == 5
    assert enrich(a, b, ["k", "s"], null_safe=False).filter(F.col("v").isNotNull()).count() == 1
