"""The cohort table: index events enriched with outcomes, demographics, stays,
lab-history features and labels (one row per index event x matching outcome rows).

Input frames use lower-case clinical column names (see FIXTURES.md).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.functions.columns import flag, paste
from cohortkit.operators.history import STATS, history_stats, pivot_stats
from cohortkit.operators.joins import enrich, semi_join
from cohortkit.operators.labels import (HORIZONS, LAG_DAYS, age_at, hours_since, in_stay, label_by_source,
                                        label_windows, qc_filter, survival_target, time_of_day)
from cohortkit.operators.pivots import one_hot_pivot
from cohortkit.sources.io import broadcast_if_small

# --- fixed values: must equal the reference for equal results -----------------
# Lab panels: test name -> item id.
LIVER = {"bilirubin_total": 50885, "alkaline_phosphatase": 50863, "alanine_transaminase": 50861,
         "aspartate_aminotransferase": 50878, "gamma_glutamyltransferase": 50927}
RENAL = {"creatinine": 50912, "bun": 51006, "potassium": 50971, "sodium": 50983, "chloride": 50902}
BLOOD = {"hemoglobin": 51222, "hematocrit": 51221, "white_blood_cells": 51300, "platelets": 51265}
PANELS = {"liver": LIVER, "renal": RENAL, "blood": BLOOD}
# QC cutoffs (a value is kept only if strictly below), by test name as intended.
THRESHOLDS_INTENDED = {
    "bilirubin_total": 20, "alkaline_phosphatase": 600, "alanine_transaminase": 100,
    "aspartate_aminotransferase": 100, "gamma_glutamyltransferase": 170,
    "creatinine": 15, "bun": 200, "potassium": 10, "sodium": 200, "chloride": 160,
    "hemoglobin": 25, "hematocrit": 75, "white_blood_cells": 100, "platelets": 1500,
}
# QC cutoffs as the reference's scripts actually apply them (cutoff paired by the
# alphabetical position of the test name, not by name).
THRESHOLDS_AS_EXECUTED = {
    "bilirubin_total": 100, "alkaline_phosphatase": 600, "alanine_transaminase": 20,
    "aspartate_aminotransferase": 100, "gamma_glutamyltransferase": 170,
    "creatinine": 10, "bun": 15, "potassium": 200, "sodium": 160, "chloride": 200,
    "hemoglobin": 75, "hematocrit": 25, "white_blood_cells": 1500, "platelets": 100,
}
OUTCOME_ORGANISM = 80139
OUTCOME_CODE = "00845"
DIARRHOEA_CODE = "78791"
# -------------------------------------------------------------------------------

ID_KEYS = ("subject_id", "hadm_id")


@dataclass
class Roles:
    """Which columns are ids, raw times, labels and features (drop by role, not by list)."""
    ids: list = field(default_factory=lambda: ["antibiotic_key", "subject_id", "hadm_id", "icustay_id"])
    raw: list = field(default_factory=lambda: ["ab_startdate", "ab_enddate", "cdiff_charttime", "org_itemid",
                                               "cdiff_icd9", "diarrhea_icd9", "dob", "admittime", "in_icu",
                                               "icu_intime", "icu_outtime", "dischtime"])
    labels: list = field(default_factory=lambda: (
        [f"cdiff_{h}d_flag" for h in HORIZONS] + ["cdiff_survival_flag", "survival_time"]
        + [f"cdiff_label_{s}_{h}d" for s in ("elisa", "icd9") for h in HORIZONS]))

    def features(self, df: DataFrame) -> list[str]:
        skip = set(self.ids) | set(self.raw) | set(self.labels)
        return [c for c in df.columns if c not in skip]


def panel_frame(spark: SparkSession, panels: Mapping[str, Mapping[str, int]] = PANELS,
                thresholds: Mapping[str, float] = THRESHOLDS_INTENDED) -> DataFrame:
    """(panel, test_name, itemid, cutoff) dimension.  A test without a cutoff is an error."""
    rows = []
    for p, tests in panels.items():
        for t, item in tests.items():
            if t not in thresholds:
                raise KeyError(f"no QC threshold for test {t!r}")
            rows.append((p, t, int(item), float(thresholds[t])))
    return spark.createDataFrame(rows, "panel string, test_name string, itemid long, cutoff double")


def index_events(rx: DataFrame, lookup: DataFrame, classes: Sequence[str] | None = None,
                 drug_col: str = "Antibiotic", class_col: str = "drug_class") -> DataFrame:
    """Prescriptions of listed drugs + surrogate key + drug-class one-hot.

    ``classes`` fixes the one-hot columns; by default they are the classes of the
    lookup that occur (bounded by the lookup size).
    """
    lk = broadcast_if_small(lookup.select(F.col(drug_col).alias("drug"), F.col(class_col).alias("drug_class")))
    x = (semi_join(rx, lk, ["drug"])
         .withColumn("antibiotic_key", paste("subject_id", "hadm_id", "icustay_id", "row_id", "drug"))
         .withColumnsRenamed({"startdate": "ab_startdate", "enddate": "ab_enddate"})
         .join(lk, "drug", "left"))
    ids = ["subject_id", "hadm_id", "icustay_id", "antibiotic_key", "ab_startdate", "ab_enddate"]
    if classes is None:
        classes = sorted(r[0] for r in x.select("drug_class").distinct().collect() if r[0] is not None)
    return one_hot_pivot(x, ids, "drug_class", classes, prefix="ab_class_is_")


def outcome_tests(micro: DataFrame, org: int = OUTCOME_ORGANISM) -> DataFrame:
    return (micro.filter(F.col("org_itemid") == org)
            .withColumnRenamed("charttime", "cdiff_charttime")
            .select("subject_id", "hadm_id", "cdiff_charttime", "org_itemid"))


def code_events(dx: DataFrame, code: str, name: str) -> DataFrame:
    return (dx.filter(F.col("icd9_code") == code)
            .withColumnRenamed("icd9_code", name)
            .select("subject_id", "hadm_id", name))


def demographics(adm: DataFrame, pat: DataFrame, admission_types: Sequence[str] | None = None) -> DataFrame:
    """Admission joined to patient, sex flag, admission-type one-hot."""
    d = (adm.join(pat.select("subject_id", "gender", "dob"), "subject_id", "left")
         .withColumn("is_female", flag(F.col("gender") == "F"))
         .select("subject_id", "hadm_id", "is_female", "dob", "admittime", "dischtime", "admission_type"))
    if admission_types is None:
        admission_types = sorted(r[0] for r in d.select("admission_type").distinct().collect() if r[0] is not None)
    ids = ["subject_id", "hadm_id", "is_female", "dob", "admittime", "dischtime"]
    return one_hot_pivot(d, ids, "admission_type", admission_types, prefix="admit_is_")


def stays(icu: DataFrame) -> DataFrame:
    return (icu.withColumnsRenamed({"intime": "icu_intime", "outtime": "icu_outtime"})
            .select("subject_id", "hadm_id", "icustay_id", "icu_intime", "icu_outtime"))


def panel_features(labs: DataFrame, index: DataFrame, panels: DataFrame,
                   stats: Sequence[str] = STATS, null_safe: bool = True, chunk_rows: int = 200_000) -> DataFrame:
    """All panels in one pass: code map + QC + history statistics + wide pivot.

    Output: (subject_id, hadm_id, antibiotic_key, ``{stat}_{test}`` ...).
    """
    tests = [r[0] for r in panels.select("test_name").collect()]  # bounded: the panel dimension
    pdim = broadcast_if_small(panels.select("itemid", "test_name", "cutoff"))
    meas = (labs.join(pdim, "itemid", "inner")
            .filter(F.col("valuenum") < F.col("cutoff"))
            .select("subject_id", "hadm_id", "test_name", "charttime", "row_id", "valuenum"))
    idx = index.select("subject_id", "hadm_id", "antibiotic_key", "ab_startdate")
    long = history_stats(meas, idx, list(ID_KEYS), test_col="test_name", time_col="charttime",
                         value_col="valuenum", order_col="row_id", index_id="antibiotic_key",
                         index_time="ab_startdate", tests=tests, stats=stats, null_safe=null_safe,
                         chunk_rows=chunk_rows)
    return pivot_stats(long, ["subject_id", "hadm_id", "antibiotic_key"], "test_name", tests, stats)


def build_training_table(index: DataFrame, tests: DataFrame, codes: DataFrame, diarrhoea: DataFrame,
                         demo: DataFrame, icu: DataFrame, features: DataFrame, *,
                         horizons: Sequence[float] = HORIZONS, lag: float = LAG_DAYS, survival_days: float = 30,
                         as_executed: bool = False, survival_event: str = "label", null_safe: bool = True,
                         multiplicity: str = "keep", drop_roles: bool = True,
                         keep_in_icu: bool = False) -> DataFrame:
    """Left-join chain + derived columns + labels + QC, as one lazy plan.

    Every join shares the (subject_id, hadm_id) prefix, so the planner can
    reuse one hash partitioning for the chain.  ``lag``: days after the start from which an outcome counts (0: from the
    start on, as in the reference's first draft); ``survival_days``: the survival window, one of ``horizons`` if its
    event is that horizon's label.
    """
    k2 = list(ID_KEYS)
    df = index
    df = enrich(df, tests, k2, null_safe=null_safe, multiplicity=multiplicity, order=["cdiff_charttime"])
    df = enrich(df, codes, k2, null_safe=null_safe)
    df = enrich(df, diarrhoea, k2, null_safe=null_safe)
    df = enrich(df, demo, k2, null_safe=null_safe)
    df = enrich(df, icu, k2 + ["icustay_id"], null_safe=null_safe)
    df = enrich(df, features, k2 + ["antibiotic_key"], null_safe=null_safe)
    df = age_at(df, "dob", "ab_startdate")
    df = hours_since(df, "admittime", "ab_startdate")
    df = in_stay(df, "ab_startdate", "icu_intime", "icu_outtime")
    df = time_of_day(df, "admittime")
    df = label_windows(df, "cdiff_charttime", "cdiff_icd9", OUTCOME_CODE, "dischtime", "ab_startdate",
                       horizons, lag, as_executed=as_executed)
    df = survival_target(df, "cdiff_charttime", "dischtime", "ab_startdate", survival_days, lag, event=survival_event,
                         label_col=f"cdiff_{int(survival_days)}d_flag")
    df = qc_filter(df)
    df = label_by_source(df, "cdiff_charttime", "cdiff_icd9", OUTCOME_CODE, "dischtime", "ab_startdate",
                         horizons, lag)
    if drop_roles:
        roles = Roles()
        drop = roles.ids + [c for c in roles.raw if not (keep_in_icu and c == "in_icu")]
        df = df.drop(*drop)
    return df
