"""Hospital readmission study: profile -> exclusions -> first encounter per
patient -> analytic table -> split, scale, dummies -> logistic model, GLM odds
ratios, cross-validation, VIF -> scored table, deciles, tiers, KPIs; over
proxy B."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import (
    band_ordinal, code_group, diag_group, flag, measured_flag, recode_sentinel,
)
from cohortlens.functions.recode import (
    DIAG_GROUPS, diag_prefix_rules, direction, safe_double, stars_from_z,
)
from cohortlens.operators import evaluation as ev
from cohortlens.operators import features as fe
from cohortlens.operators import history, lookup, models, profiling
from cohortlens.plans import scoring
from cohortlens.session import shared_path, stored
from cohortlens.sources import export, staging
from cohortlens.sources.proxies import RAW_B_SQL, raw_encounters, read_table

# Dispositions meaning death or hospice (excluded), the invalid
# gender text, dispositions grouped as Home, admission-type labels kept.
EXCLUDED_DISPOSITIONS = ["11", "13", "14", "19", "20", "21"]
INVALID_GENDER = "Unknown/Invalid"
HOME_DISPOSITIONS = ["1", "6", "8"]
ADMISSION_TYPES = {"1": "Emergency", "2": "Urgent", "3": "Elective"}
# Model inputs.
NUMERIC = ["age_ordinal", "number_outpatient", "number_emergency", "number_inpatient",
           "time_in_hospital", "num_lab_procedures", "num_procedures", "num_medications",
           "number_diagnoses", "a1c_tested", "glucose_tested", "med_changed",
           "on_diabetes_med", "on_insulin"]
CATEGORICAL = ["race", "gender", "diag1_group", "discharge_group", "admission_type_grp"]
PROFILE_NUMERIC = ["time_in_hospital", "num_lab_procedures", "num_procedures", "num_medications",
                   "number_outpatient", "number_emergency", "number_inpatient", "number_diagnoses"]
PROFILE_CATEGORICAL = ["gender", "age", "A1Cresult", "max_glu_serum", "change", "diabetesMed"]
COUNT_COLS = ["number_outpatient", "number_emergency", "number_inpatient", "time_in_hospital",
              "num_lab_procedures", "num_procedures", "num_medications", "number_diagnoses"]
VIF_PAIR = ["num_medications", "num_lab_procedures"]
VIF_THREE = ["num_medications", "num_lab_procedures", "time_in_hospital"]


# ------------------------------------------------------------------ chain
def is_eligible() -> Column:
    return ~F.col("discharge_disposition_id").isin(EXCLUDED_DISPOSITIONS) & (F.col("gender") != INVALID_GENDER)


def eligible(raw: DataFrame) -> DataFrame:
    """Row exclusions, applied before the first-encounter choice."""
    return raw.where(is_eligible())


def first_encounters(elig: DataFrame) -> DataFrame:
    """Each patient's lowest numeric encounter id."""
    keyed = elig.withColumn("__enc", F.col("encounter_id").try_cast("bigint"))
    return history.first_per_entity(keyed, "patient_nbr", "__enc").drop("__enc")


def analytic(first: DataFrame) -> DataFrame:
    as_int = lambda c: F.col(c).try_cast("int").alias(c)
    return first.select(
        F.col("encounter_id").try_cast("bigint").alias("encounter_id"),
        F.col("patient_nbr").try_cast("bigint").alias("patient_nbr"),
        flag(F.col("readmitted") == "<30").alias("readmitted_30"),
        recode_sentinel("race", "?", "Unknown").alias("race"),
        "gender",
        F.col("age").alias("age_band"),
        band_ordinal("age").alias("age_ordinal"),
        *[as_int(c) for c in COUNT_COLS],
        measured_flag("A1Cresult").alias("a1c_tested"),
        measured_flag("max_glu_serum").alias("glucose_tested"),
        flag(F.col("change") == "Ch").alias("med_changed"),
        flag(F.col("diabetesMed") == "Yes").alias("on_diabetes_med"),
        flag(F.col("insulin") != "No").alias("on_insulin"),
        diag_group("diag_1").alias("diag1_group"),
        code_group("discharge_disposition_id", members=HOME_DISPOSITIONS, label="Home",
                   default="Transferred/Other").alias("discharge_group"),
        code_group("admission_type_id", ADMISSION_TYPES, "Other").alias("admission_type_grp"),
    )


def analytic_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytic(first_encounters(eligible(raw_encounters(spark, sf_dir))))


def split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fe.stratified_split(analytic_table(spark, sf_dir), "encounter_id", "readmitted_30")


def stored_analytic(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Columns of the analytic table as a stored table.  Levels, deviations and a fit
    are jobs of their own: each would build the chain from the raw rows again."""
    return stored(analytic_table(spark, sf_dir).select(*cols), "analytic")


def stored_split(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """The same of the split table (all columns unless some are named)."""
    return stored(split_table(spark, sf_dir).select(*(cols or "*")), "split")


# ---------------------------------------------------------------- profile
def q_hr_key_audit(spark, sf_dir):
    return profiling.key_audit(raw_encounters(spark, sf_dir),
                               {"unique_encounters": "encounter_id", "unique_patients": "patient_nbr"})


def q_readmit_dist(spark, sf_dir):
    return profiling.value_distribution(raw_encounters(spark, sf_dir), "readmitted", digits=2)


def q_sentinel_audit(spark, sf_dir):
    return profiling.sentinel_audit(raw_encounters(spark, sf_dir), "?")


def q_duplication(spark, sf_dir):
    return profiling.duplication(raw_encounters(spark, sf_dir), "patient_nbr")


def q_exclusion_evidence(spark, sf_dir):
    return profiling.exclusion_evidence(raw_encounters(spark, sf_dir), "discharge_disposition_id",
                                        F.col("readmitted") == "<30", EXCLUDED_DISPOSITIONS)


def q_excluded_share(spark, sf_dir):
    raw = raw_encounters(spark, sf_dir)
    ex = F.col("discharge_disposition_id").isin(EXCLUDED_DISPOSITIONS)
    return raw.agg(F.count_if(ex).alias("excluded_rows"),
                   F.round(F.try_divide(100.0 * F.count_if(ex), F.count(F.lit(1))), 2).alias("excluded_pct"))


def q_numeric_summary(spark, sf_dir):
    return profiling.numeric_summary(raw_encounters(spark, sf_dir), PROFILE_NUMERIC)


def q_categoricals(spark, sf_dir):
    return profiling.value_distribution_long(raw_encounters(spark, sf_dir), PROFILE_CATEGORICAL, 2)


# ------------------------------------------------------------------ clean
def q_first_encounter(spark, sf_dir):
    f = first_encounters(eligible(raw_encounters(spark, sf_dir)))
    return f.select("patient_nbr", "encounter_id", "readmitted")


def q_analytic(spark, sf_dir):
    return analytic_table(spark, sf_dir)


def q_reconcile(spark, sf_dir):
    """Rows of each stage: one aggregate before the first encounters are chosen, one
    after (there, each row of a patient is one of the analytic table)."""
    raw = raw_encounters(spark, sf_dir)
    before = raw.agg(F.count(F.lit(1)).alias("raw_rows"), F.count_if(is_eligible()).alias("after_exclusions"))
    after = analytic(first_encounters(eligible(raw))).agg(
        F.count("patient_nbr").alias("after_first_encounter"), F.count(F.lit(1)).alias("analytic_rows"),
        F.round(F.avg("readmitted_30") * 100, 2).alias("readmit30_pct"))
    return before.crossJoin(after)  # one row each


def q_diag_group(spark, sf_dir):
    raw = raw_encounters(spark, sf_dir)
    return raw.groupBy(diag_group("diag_1").alias("diag1_group")).agg(F.count(F.lit(1)).alias("n"))


def q_diag_group_join(spark, sf_dir):
    """The same grouping as a broadcast range-table lookup (must equal
    q_diag_group)."""
    raw = raw_encounters(spark, sf_dir).select("diag_1")
    ranges = lookup.range_table(spark, DIAG_GROUPS)
    j = lookup.range_lookup(raw, safe_double("diag_1"), ranges, "range_group")
    g = diag_prefix_rules("diag_1", F.coalesce(F.col("range_group"), F.lit("Other")))
    return j.groupBy(g.alias("diag1_group")).agg(F.count(F.lit(1)).alias("n"))


def q_code_groups(spark, sf_dir):
    raw = raw_encounters(spark, sf_dir)
    return raw.groupBy(
        code_group("discharge_disposition_id", members=HOME_DISPOSITIONS, label="Home",
                   default="Transferred/Other").alias("discharge_group"),
        code_group("admission_type_id", ADMISSION_TYPES, "Other").alias("admission_type_grp"),
    ).agg(F.count(F.lit(1)).alias("n"))


def q_analytic_nulls(spark, sf_dir):
    """Null cells of the analytic table: per column and in total."""
    per = profiling.null_audit(analytic_table(spark, sf_dir), with_types=False)
    total = per.agg(F.sum("nulls").cast("bigint").alias("total_null_cells"))
    return per.crossJoin(total)


def q_analytic_diag_dist(spark, sf_dir):
    """Primary-diagnosis groups of the modelled patients."""
    return profiling.value_distribution(analytic_table(spark, sf_dir), "diag1_group", digits=2)


def q_target_balance(spark, sf_dir):
    return profiling.value_distribution(analytic_table(spark, sf_dir), "readmitted_30", digits=2)


def q_code_labels(spark, sf_dir):
    """Code -> label dimensions: customers per nation and region name.  Counted by
    code first; the labels join the counts."""
    c = read_table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    places = lookup.code_labels(read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region"), "n_regionkey", "r_regionkey", "r_name")
    j = c.join(places.select("n_nationkey", "n_name", "r_name"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy("r_name", "n_name").agg(F.sum("n").alias("customers"))


# --------------------------------------------------------------- features
def q_split(spark, sf_dir):
    s = split_table(spark, sf_dir)
    return s.groupBy("split", "readmitted_30").agg(F.count(F.lit(1)).alias("n"))


def q_folds(spark, sf_dir):
    s = split_table(spark, sf_dir).where(F.col("split") == "train")
    return s.groupBy("fold", "readmitted_30").agg(F.count(F.lit(1)).alias("n"))


def q_attach(spark, sf_dir):
    s = split_table(spark, sf_dir).where(F.col("split") == "test").select(
        "encounter_id", "readmitted_30")
    # A column of the raw rows, by key; the chain isn't built again.
    raw = raw_encounters(spark, sf_dir).select(F.col("encounter_id").try_cast("bigint").alias("encounter_id"), F.col("age").alias("age_band"))
    return lookup.attach(s, raw, "encounter_id", ["age_band"])


def q_majority_baseline(spark, sf_dir):
    s = split_table(spark, sf_dir)
    return models.majority_baseline(s.where(F.col("split") == "train"),
                                    s.where(F.col("split") == "test"), "readmitted_30")


def q_standardize(spark, sf_dir):
    s = split_table(spark, sf_dir)
    stats = fe.population_stats(s.where(F.col("split") == "train"), NUMERIC)
    z = fe.standardize(s.where(F.col("split") == "test").select("encounter_id", *NUMERIC),
                       NUMERIC, stats)
    return z.select("encounter_id", *[F.round(c, 6).alias(c) for c in NUMERIC])


def q_dummies(spark, sf_dir):
    s = split_table(spark, sf_dir)
    levels = fe.category_levels(s.where(F.col("split") == "train"), CATEGORICAL)
    return fe.dummies_full(s, "encounter_id", CATEGORICAL, levels)


def q_vif2(spark, sf_dir):
    v = models.vif(stored_analytic(spark, sf_dir, *VIF_PAIR), VIF_PAIR)
    return v.select("feature", F.round("vif", 6).alias("vif"))


def q_vif3(spark, sf_dir):
    """Three predictors, with the largest factor and the verdict on all."""
    v = models.vif(stored_analytic(spark, sf_dir, *VIF_THREE), VIF_THREE)
    s = models.vif_summary(v)
    return v.crossJoin(F.broadcast(s)).select("feature", F.round("vif", 6).alias("vif"), F.round("max_vif", 6).alias("max_vif"), "max_feature", "verdict")


def q_wide_odds(spark, sf_dir):
    """Odds of a late order by customer nation (a category absorbed level by level)
    against the first nation that has both outcomes."""
    o = read_table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"))
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    odds = models.fit_wide_logit(o.join(c, "o_custkey"), "nation", [], "urgent")
    return odds.select("predictor", F.round("odds_ratio", 4).alias("odds_ratio"), F.round("std_error", 4).alias("std_error"), "significant")


def q_range_labels(spark, sf_dir):
    """Orders by price range, the ranges being those between the totals of parts:
    a range table that grows with the data, joined by bins."""
    cuts = read_table(spark, sf_dir, "part").select(F.round(F.col("p_retailprice").cast("double") * 100, 0).alias("lo")).distinct()
    ranges = cuts.select(F.format_string("from %.0f", "lo").alias("range_label"), "lo", (F.col("lo") + 0.5).alias("hi"))
    o = read_table(spark, sf_dir, "lineitem").select(F.round(F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double") * 100, 0).alias("unit"))
    j = lookup.range_join(o, F.col("unit"), ranges)
    return j.groupBy(F.col("range_label").isNotNull().alias("in_a_range")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("range_label").alias("ranges"))


def q_odds_2x2(spark, sf_dir):
    """Unpenalised GLM on one binary predictor; its odds ratio and standard
    error equal the 2x2 closed form ad/bc and sqrt(1/a+1/b+1/c+1/d)."""
    a = stored_analytic(spark, sf_dir, "discharge_group", "readmitted_30").withColumn(
        "discharge_not_home", flag(F.col("discharge_group") == "Transferred/Other").cast("double"))
    odds = models.fit_glm_odds(a, ["discharge_not_home"], "readmitted_30")
    reported = F.round("odds_ratio", 4)
    return odds.select("predictor", reported.alias("odds_ratio"),
                       F.round("std_error", 4).alias("std_error"),
                       stars_from_z("z").alias("signif"),
                       direction(reported).alias("direction"))


# ------------------------------------------------------------ model (rows)
def model_frame(spark: SparkSession, sf_dir: str):
    """Split table with scaled numerics and drop-first dummies assembled."""
    s = stored_split(spark, sf_dir)
    train = s.where(F.col("split") == "train")
    stats = fe.population_stats(train, NUMERIC)
    pairs = fe.level_pairs(fe.category_levels(train, CATEGORICAL))
    scaled = fe.standardize(s, NUMERIC, stats, suffix="__z")
    wide, dummy_names = fe.dummy_columns(scaled, CATEGORICAL, pairs)
    data = fe.assemble(wide, [c + "__z" for c in NUMERIC] + dummy_names)
    return data, dummy_names


def fitted(spark, sf_dir):
    data, names = model_frame(spark, sf_dir)
    train = data.where(F.col("split") == "train")
    test = data.where(F.col("split") == "test")
    m = models.fit_logistic(train, "features", "readmitted_30")
    return models.score(m, test), data, names


def model_scores(spark, sf_dir):
    """(label, score) of the test rows as a stored table, and the data of the model."""
    scored, data, _ = fitted(spark, sf_dir)
    s = scored.select(F.col("readmitted_30").alias("label"), F.col("predicted_prob").alias("score"))
    return stored(s, "model_scores"), data


def q_model_metrics(spark, sf_dir):
    return ev.ranking_metrics(model_scores(spark, sf_dir)[0])


def q_model_deciles(spark, sf_dir):
    return ev.decile_table(ev.qcut(model_scores(spark, sf_dir)[0]))


def q_model_sweep(spark, sf_dir):
    return ev.threshold_sweep(model_scores(spark, sf_dir)[0])


def q_model_operating_point(spark, sf_dir):
    """Flag the top 20 % of test discharges by model score: the cut-off and
    the confusion matrix with recall, precision and share flagged."""
    t = ev.ScoreTable(model_scores(spark, sf_dir)[0])
    cut = t.quantiles([1.0 - ev.TIER_HIGH])[0]
    return t.confusion(cut).withColumn("threshold", F.lit(cut).cast("double"))


def q_scored_patients(spark, sf_dir):
    scored, _, _ = fitted(spark, sf_dir)
    s = scored.select("encounter_id", *NUMERIC, *CATEGORICAL, "age_band", F.col("predicted_prob").alias("score"), "readmitted_30")
    s = ev.deciles_and_tiers(stored(s, "scored_patients"), "score", decile="risk_decile")
    return s.select("encounter_id", *NUMERIC, *CATEGORICAL, "age_band",
                    F.bround("score", 4).alias("predicted_prob"),
                    F.col("readmitted_30").alias("actual_readmit"), "risk_decile", "risk_tier")


def q_model_kpi(spark, sf_dir):
    s, data = model_scores(spark, sf_dir)
    return ev.ScoreTable(s).kpi(data.select(F.col("readmitted_30").alias("label")))


def q_odds_table(spark, sf_dir):
    s = stored_split(spark, sf_dir, "split", "readmitted_30", *NUMERIC, *CATEGORICAL)
    train = s.where(F.col("split") == "train")
    pairs = fe.level_pairs(fe.category_levels(train, CATEGORICAL))
    wide, names = fe.dummy_columns(train, CATEGORICAL, pairs)
    return models.fit_glm_odds(wide, NUMERIC + names, "readmitted_30")


def q_significant_odds(spark, sf_dir):
    return models.significant_predictors(q_odds_table(spark, sf_dir))


def q_cv_auc(spark, sf_dir):
    train = split_table(spark, sf_dir).where(F.col("split") == "train")
    return models.fold_summary(models.cross_validated_auc(train, NUMERIC, CATEGORICAL, "readmitted_30"))


# A model of one categorical predictor with next to no penalty gives each group
# its rate, so these have SQL.
GROUP = "diag1_group"
NO_PENALTY = 1e9
KPI = ["total_rows", "test_rows", "baseline_rate_pct", "model_auc", "high_tier_share_pct", "high_tier_rate_pct",
       "recall_at_high_tier_pct", "precision_at_high_tier_pct", "lift_top_decile"]


def group_split(spark, sf_dir):
    return stored_split(spark, sf_dir, "encounter_id", "readmitted_30", GROUP, "split")


def group_scores(s: DataFrame) -> DataFrame:
    """Test rows of a split table scored by the model of one categorical predictor."""
    train = s.where(F.col("split") == "train")
    wide, names = fe.dummy_columns(s, [GROUP], fe.level_pairs(fe.category_levels(train, [GROUP])))
    data = fe.assemble(wide, names)
    m = models.fit_logistic(data.where(F.col("split") == "train"), "features", "readmitted_30", NO_PENALTY)
    scored = models.score(m, data.where(F.col("split") == "test"))
    return scored.select("encounter_id", F.col("readmitted_30").alias("label"), F.round("predicted_prob", 4).alias("score"))


def q_group_scores(spark, sf_dir):
    return group_scores(group_split(spark, sf_dir))


def q_group_metrics(spark, sf_dir):
    return ev.ranking_metrics(stored(group_scores(group_split(spark, sf_dir)), "group_scores"))


def group_odds(a: DataFrame) -> DataFrame:
    """Odds of each diagnosis group against the first one, with stars from p."""
    wide, names = fe.dummy_columns(a, [GROUP], fe.level_pairs(fe.category_levels(a, [GROUP])))
    odds = models.fit_glm_odds(wide, names, "readmitted_30")
    return odds.select("predictor", F.round("odds_ratio", 4).alias("odds_ratio"),
                       F.round("std_error", 4).alias("std_error"), "signif", "direction", "significant")


def q_group_odds(spark, sf_dir):
    return group_odds(stored_analytic(spark, sf_dir, GROUP, "readmitted_30"))


def q_bundle(spark, sf_dir):
    """The export of one fit: scored rows, decile, KPI and odds tables from one stored
    score table, written as a bundle and read back; every value in long form."""
    name = lambda x: shared_path(spark, f"{x}_{uuid.uuid4().hex}")
    split = group_split(spark, sf_dir)
    scored = stored(group_scores(split), "bundle_scores")
    table = ev.ScoreTable(scored)
    rows = scored.select("encounter_id", F.bround("score", 4).alias("predicted_prob"), "label", table.bins().alias("risk_decile"), table.tier().alias("risk_tier"))
    paths = export.write_bundle({"scored": rows, "deciles": table.deciles(rate_digits=2).drop("rate", "avg_score"), "kpi": table.kpi(),
                                 "odds": group_odds(split)}, name("bundle"))
    back = {k: staging.stage_csv_by_header(spark, p) for k, p in paths.items()}
    s = back["scored"]
    long = s.groupBy("risk_decile", "risk_tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("predicted_prob").cast("double")), 6).alias("sum_prob"),
                                                     F.sum(F.col("encounter_id").cast("bigint")).alias("sum_ids"))
    long = long.select(F.lit("scored").alias("tab"), F.concat_ws("/", "risk_decile", "risk_tier").alias("key"), *[F.col(c).cast("double").alias(c) for c in ("n", "sum_prob", "sum_ids")])
    long = long.unpivot(["tab", "key"], ["n", "sum_prob", "sum_ids"], "metric", "value")
    for tab, key, metrics in (("deciles", "decile", ["n", "positives", "rate_pct", "capture_pct", "contacted_pct"]), ("kpi", None, KPI), ("odds", "predictor", ["odds_ratio", "std_error"])):
        t = back[tab].select(F.lit(tab).alias("tab"), (F.lit("") if key is None else F.col(key)).alias("key"), *[F.col(c).cast("double").alias(c) for c in metrics])
        long = long.unionByName(t.unpivot(["tab", "key"], metrics, "metric", "value"))
    return long


def q_group_cv_auc(spark, sf_dir):
    train = split_table(spark, sf_dir).where(F.col("split") == "train")
    aucs = models.cross_validated_auc(train, [], [GROUP], "readmitted_30", c=NO_PENALTY, score_digits=4)
    return aucs.select("fold", F.round("auc", 6).alias("auc"))


def q_assembled(spark, sf_dir):
    """The assembled vectors of the test rows, one row per entry that isn't 0."""
    data, dummies = model_frame(spark, sf_dir)
    names = F.array(*[F.lit(n) for n in NUMERIC + dummies])
    v = data.where(F.col("split") == "test").select("encounter_id", F.posexplode(vector_to_array("features")).alias("pos", "v"))
    return v.select("encounter_id", names[F.col("pos")].alias("feature"), F.round("v", 6).alias("value")).where(F.col("value") != 0)


def q_vif(spark, sf_dir):
    return models.vif(stored_analytic(spark, sf_dir, *NUMERIC), NUMERIC).withColumn(
        "verdict", F.when(F.col("vif") < 5, "ok").otherwise("review"))


QUERIES = {name: fn for name, fn in globals().items() if name.startswith("q_")}


def _dq(col):
    return f"TRY_CAST({col} AS DOUBLE)"


# Oracle texts from the same constants as the code: groups are looked up in lists
# of ranges and of prefixes.
_RANGES = ", ".join(f"{{'g': '{g}', 'lo': {lo}, 'hi': {hi}}}" for g, spans, singles in DIAG_GROUPS
                    for lo, hi in [*spans, *((x, x) for x in singles)])
_PREFIXES = ", ".join(f"{{'g': '{g}', 'p': '{p}'}}" for p, g in (("?", "Missing"), ("E", "Other"), ("V", "Other"), ("250", "Diabetes")))
_DIAG_SQL = (f"COALESCE(list_filter([{_PREFIXES}], lambda r: starts_with(diag_1, r.p))[1].g, "
             f"list_filter([{_RANGES}], lambda r: {_dq('diag_1')} BETWEEN r.lo AND r.hi)[1].g, 'Other')")
_DISCHARGE_SQL = f"['Transferred/Other', 'Home'][1 + COALESCE(list_contains({HOME_DISPOSITIONS!r}, discharge_disposition_id), false)::INTEGER]"
_ADMISSION_SQL = ("COALESCE(list_filter([" + ", ".join(f"{{'k': '{k}', 'v': '{v}'}}" for k, v in ADMISSION_TYPES.items())
                  + "], lambda r: r.k = admission_type_id)[1].v, 'Other')")
_FLAGS = {"readmitted_30": "readmitted = '<30'", "a1c_tested": "A1Cresult <> 'None'", "glucose_tested": "max_glu_serum <> 'None'",
          "med_changed": "change = 'Ch'", "on_diabetes_med": "diabetesMed = 'Yes'", "on_insulin": "insulin <> 'No'"}
_EXCL = ", ".join(f"'{c}'" for c in EXCLUDED_DISPOSITIONS)

CHAIN_SQL = RAW_B_SQL + f""",
eligible AS (SELECT * FROM raw_b WHERE NOT (list_contains([{_EXCL}], discharge_disposition_id) OR gender = '{INVALID_GENDER}')),
first_enc AS (SELECT e.* FROM eligible e JOIN (SELECT patient_nbr, MIN(encounter_id::BIGINT) AS lowest FROM eligible GROUP BY 1) f
              ON f.patient_nbr = e.patient_nbr AND f.lowest = e.encounter_id::BIGINT),
analytic AS (
  SELECT encounter_id::BIGINT AS encounter_id, patient_nbr::BIGINT AS patient_nbr, gender, age AS age_band,
         COALESCE(NULLIF(race, '?'), 'Unknown') AS race, string_split(age[2:], '-')[1]::INTEGER / 10 + 1 AS age_ordinal,
         {", ".join(f"{c}::INTEGER AS {c}" for c in COUNT_COLS)},
         {", ".join(f"COALESCE({test}, false)::INTEGER AS {c}" for c, test in _FLAGS.items())},
         {_DIAG_SQL} AS diag1_group, {_DISCHARGE_SQL} AS discharge_group, {_ADMISSION_SQL} AS admission_type_grp
  FROM first_enc),
class_share AS (
  SELECT y, wanted, wanted * n // total AS whole, wanted * n % total AS rest
  FROM (SELECT readmitted_30 AS y, COUNT(*) AS n FROM analytic GROUP BY 1),
       (SELECT COUNT(*) AS total, CAST(CEIL(COUNT(*) * {fe.TEST_SHARE!r}) AS BIGINT) AS wanted FROM analytic)),
class_cut AS (
  SELECT y, whole + (wanted - (SELECT SUM(whole) FROM class_share)
                     >= ROW_NUMBER() OVER (ORDER BY rest DESC, y))::INTEGER AS cut
  FROM class_share),
split AS (
  SELECT * EXCLUDE (y), CASE WHEN rn <= cut THEN 'test' ELSE 'train' END AS split,
         CASE WHEN rn > cut THEN CAST((rn - cut - 1) % {fe.N_FOLDS} AS INTEGER) END AS fold
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY readmitted_30 ORDER BY h, encounter_id) AS rn
        FROM (SELECT *, ('0x' || substr(md5(CAST(encounter_id AS VARCHAR) || ':{fe.SEED}'), 1, 15))::BIGINT AS h
              FROM analytic)) JOIN class_cut ON y = readmitted_30)"""


def _w(body: str) -> str:
    return "WITH " + CHAIN_SQL + "\n" + body


_SENT_COLS = ["encounter_id", "patient_nbr", "readmitted", "race", "gender", "age",
              "discharge_disposition_id", "admission_type_id", "number_inpatient", "number_emergency",
              "number_outpatient", "time_in_hospital", "num_lab_procedures", "num_procedures",
              "num_medications", "number_diagnoses", "A1Cresult", "max_glu_serum", "change",
              "diabetesMed", "insulin", "diag_1"]

ORACLE = {
    "q_hr_key_audit": _w("""SELECT COUNT(*) AS total_rows, COUNT(DISTINCT encounter_id) AS unique_encounters,
       COUNT(DISTINCT patient_nbr) AS unique_patients, 22 AS n_columns FROM raw_b"""),
    "q_readmit_dist": _w("""SELECT readmitted, COUNT(*) AS n,
       ROUND(100.0 * COUNT(*) / (SELECT COUNT(*) FROM raw_b), 2) AS pct FROM raw_b GROUP BY readmitted"""),
    "q_sentinel_audit": _w("SELECT column_name, n, ROUND(100.0 * n / (SELECT COUNT(*) FROM raw_b), 2) AS pct FROM (UNPIVOT (SELECT "
                           + ", ".join(f"COUNT(*) FILTER (WHERE {c} = '?') AS {c}" for c in _SENT_COLS)
                           + " FROM raw_b) ON COLUMNS(*) INTO NAME column_name VALUE n) WHERE n > 0"),
    "q_duplication": _w("""SELECT COUNT(*) FILTER (WHERE k = 1) AS single_entities,
       COUNT(*) FILTER (WHERE k > 1) AS repeated_entities, MAX(k) AS max_rows_per_entity,
       SUM(k) - COUNT(*) AS extra_rows
FROM (SELECT patient_nbr, COUNT(*) AS k FROM raw_b GROUP BY patient_nbr)"""),
    "q_exclusion_evidence": _w(f"""SELECT discharge_disposition_id, COUNT(*) AS n,
       ROUND(100.0 * AVG(CASE WHEN readmitted = '<30' THEN 1 ELSE 0 END), 2) AS rate_pct,
       discharge_disposition_id IN ({_EXCL}) AS excluded,
       TRY_CAST(discharge_disposition_id AS BIGINT) AS code_order
FROM raw_b GROUP BY discharge_disposition_id"""),
    "q_excluded_share": _w(f"""SELECT COUNT(*) FILTER (WHERE discharge_disposition_id IN ({_EXCL})) AS excluded_rows,
       ROUND(100.0 * COUNT(*) FILTER (WHERE discharge_disposition_id IN ({_EXCL})) / COUNT(*), 2) AS excluded_pct
FROM raw_b"""),
    "q_numeric_summary": _w("""SELECT column_name, MIN(v) AS min_value, MEDIAN(v) AS median_value,
       ROUND(AVG(v), 2) AS mean_value, MAX(v) AS max_value
FROM (UNPIVOT (SELECT """ + ", ".join(f"TRY_CAST({c} AS DOUBLE) AS {c}" for c in PROFILE_NUMERIC)
                            + """ FROM raw_b) ON COLUMNS(*) INTO NAME column_name VALUE v)
GROUP BY column_name"""),
    "q_categoricals": _w("""SELECT column_name, value, COUNT(*) AS n,
       ROUND(100.0 * COUNT(*) / (SELECT COUNT(*) FROM raw_b), 2) AS pct
FROM (UNPIVOT (SELECT """ + ", ".join(PROFILE_CATEGORICAL) + """ FROM raw_b)
      ON COLUMNS(*) INTO NAME column_name VALUE value)
GROUP BY column_name, value"""),
    "q_first_encounter": _w("SELECT patient_nbr, encounter_id, readmitted FROM first_enc"),
    "q_analytic": _w("SELECT * FROM analytic"),
    "q_reconcile": _w("""SELECT (SELECT COUNT(*) FROM raw_b) AS raw_rows, (SELECT COUNT(*) FROM eligible) AS after_exclusions,
       (SELECT COUNT(*) FROM first_enc) AS after_first_encounter, (SELECT COUNT(*) FROM analytic) AS analytic_rows,
       (SELECT ROUND(AVG(readmitted_30) * 100, 2) FROM analytic) AS readmit30_pct"""),
    "q_diag_group": _w(f"SELECT {_DIAG_SQL} AS diag1_group, COUNT(*) AS n FROM raw_b GROUP BY 1"),
    "q_diag_group_join": _w(f"SELECT {_DIAG_SQL} AS diag1_group, COUNT(*) AS n FROM raw_b GROUP BY 1"),
    "q_code_groups": _w(f"""SELECT {_DISCHARGE_SQL} AS discharge_group, {_ADMISSION_SQL} AS admission_type_grp,
       COUNT(*) AS n FROM raw_b GROUP BY 1, 2"""),
    "q_analytic_nulls": _w("""SELECT column_name, nulls, SUM(nulls) OVER () AS total_null_cells
FROM (UNPIVOT (SELECT """ + ", ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in
                                      ["encounter_id", "patient_nbr", "readmitted_30", "race", "gender",
                                       "age_band", "age_ordinal"] + COUNT_COLS +
                                      ["a1c_tested", "glucose_tested", "med_changed", "on_diabetes_med",
                                       "on_insulin", "diag1_group", "discharge_group", "admission_type_grp"])
                         + """ FROM analytic) ON COLUMNS(*) INTO NAME column_name VALUE nulls)"""),
    "q_analytic_diag_dist": _w("""SELECT diag1_group, COUNT(*) AS n,
       ROUND(100.0 * COUNT(*) / (SELECT COUNT(*) FROM analytic), 2) AS pct FROM analytic GROUP BY diag1_group"""),
    "q_target_balance": _w("""SELECT readmitted_30, COUNT(*) AS n,
       ROUND(100.0 * COUNT(*) / (SELECT COUNT(*) FROM analytic), 2) AS pct FROM analytic GROUP BY readmitted_30"""),
    "q_code_labels": """SELECT r_name, n_name, COUNT(*) AS customers
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name, n_name""",
    "q_split": _w("SELECT split, readmitted_30, COUNT(*) AS n FROM split GROUP BY split, readmitted_30"),
    "q_folds": _w("SELECT fold, readmitted_30, COUNT(*) AS n FROM split WHERE split = 'train' GROUP BY fold, readmitted_30"),
    "q_attach": _w("""SELECT s.encounter_id, s.readmitted_30, a.age_band FROM split s
JOIN analytic a ON s.encounter_id = a.encounter_id WHERE s.split = 'test'"""),
    "q_majority_baseline": _w("""SELECT majority_class,
       ROUND(100.0 * AVG(CASE WHEN majority_class = readmitted_30 THEN 1 ELSE 0 END), 2) AS accuracy_pct,
       ROUND(100.0 * COALESCE(CAST(COUNT(*) FILTER (WHERE majority_class = 1 AND readmitted_30 = 1) AS DOUBLE)
                              / COUNT(*) FILTER (WHERE readmitted_30 = 1), 0.0), 2) AS recall_pct
FROM split, (SELECT readmitted_30 AS majority_class FROM split WHERE split = 'train'
             GROUP BY readmitted_30 ORDER BY COUNT(*) DESC, readmitted_30 LIMIT 1)
WHERE split = 'test' GROUP BY majority_class"""),
    "q_standardize": _w("SELECT encounter_id, " + ", ".join(
        f"ROUND(CASE WHEN sd_{c} > 0 THEN ({c} - m_{c}) / sd_{c} ELSE {c} - m_{c} END, 6) AS {c}" for c in NUMERIC)
        + " FROM split, (SELECT " + ", ".join(f"AVG({c}) AS m_{c}, STDDEV_POP({c}) AS sd_{c}" for c in NUMERIC)
        + " FROM split WHERE split = 'train') WHERE split = 'test'"),
    "q_dummies": _w("""SELECT s.encounter_id, l.feature || '_' || l.level AS dummy,
       CAST(CASE WHEN s.value = l.level THEN 1.0 ELSE 0.0 END AS DOUBLE) AS value
FROM (UNPIVOT (SELECT encounter_id, """ + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in CATEGORICAL)
                    + """ FROM split) ON """ + ", ".join(CATEGORICAL) + """ INTO NAME feature VALUE value) s
JOIN (SELECT feature, level FROM (
        SELECT DISTINCT feature, level FROM (UNPIVOT (SELECT """
                    + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in CATEGORICAL)
                    + """ FROM split WHERE split = 'train') ON """ + ", ".join(CATEGORICAL)
                    + """ INTO NAME feature VALUE level))
      QUALIFY level <> MIN(level) OVER (PARTITION BY feature)) l ON s.feature = l.feature"""),
    "q_vif2": _w(f"""SELECT feature, ROUND(1.0 / (1.0 - r * r), 6) AS vif
FROM (SELECT CORR({VIF_PAIR[0]}, {VIF_PAIR[1]}) AS r FROM analytic),
     (VALUES ('{VIF_PAIR[0]}'), ('{VIF_PAIR[1]}')) t(feature)"""),
    "q_vif3": _w("""SELECT feature, ROUND(v, 6) AS vif, ROUND(MAX(v) OVER (), 6) AS max_vif,
       FIRST_VALUE(feature) OVER (ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS max_feature,
       CASE WHEN MAX(v) OVER () < 5 THEN 'ok' ELSE 'review' END AS verdict
FROM (SELECT feature, (1 - other * other) / (1 - a * a - b * b - other * other + 2 * a * b * other) AS v
      FROM (SELECT CORR({0}, {1}) AS r12, CORR({0}, {2}) AS r13, CORR({1}, {2}) AS r23 FROM analytic),
           LATERAL (VALUES ('{0}', r12, r13, r23), ('{1}', r12, r23, r13), ('{2}', r13, r23, r12)) t(feature, a, b, other))""".format(*VIF_THREE)),
    "q_wide_odds": """WITH t AS (SELECT c_nationkey::VARCHAR AS g, SUM((o_orderpriority = '1-URGENT')::INTEGER) AS a, SUM((o_orderpriority <> '1-URGENT')::INTEGER) AS b
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
o AS (SELECT t.g, CAST(t.a AS DOUBLE) * r.b / (CAST(t.b AS DOUBLE) * r.a) AS ratio, SQRT(1.0 / t.a + 1.0 / t.b + 1.0 / r.a + 1.0 / r.b) AS se
      FROM t, t r WHERE r.g = (SELECT MIN(g) FROM t WHERE a > 0 AND b > 0) AND t.g <> r.g)
SELECT 'nation_' || g AS predictor, ROUND(ratio, 4) AS odds_ratio, ROUND(se, 4) AS std_error, ABS(ln(ratio)) / se > 1.959963984540054 AS significant FROM o""",
    "q_range_labels": """WITH r AS (SELECT DISTINCT ROUND(p_retailprice::DOUBLE * 100, 0) AS lo FROM part),
o AS (SELECT ROUND(l_extendedprice::DOUBLE / l_quantity::DOUBLE * 100, 0) AS unit FROM lineitem)
SELECT lo IS NOT NULL AS in_a_range, COUNT(*) AS n, COUNT(DISTINCT lo) AS ranges FROM o LEFT JOIN r ON unit BETWEEN lo AND lo + 0.5 GROUP BY 1""",
    "q_odds_2x2": _w(f"""SELECT 'discharge_not_home' AS predictor, ROUND(odds_ratio, 4) AS odds_ratio,
       ROUND(se, 4) AS std_error,
       CASE WHEN ABS(ln(odds_ratio) / se) > {3.2905267314919255!r} THEN '***'
            WHEN ABS(ln(odds_ratio) / se) > {2.5758293035489004!r} THEN '**'
            WHEN ABS(ln(odds_ratio) / se) > {1.959963984540054!r} THEN '*' ELSE '' END AS signif,
       CASE WHEN ROUND(odds_ratio, 4) > 1 THEN 'Increases risk' ELSE 'Decreases risk' END AS direction
FROM (SELECT CAST(a AS DOUBLE) * d / (CAST(b AS DOUBLE) * c) AS odds_ratio,
             SQRT(1.0 / a + 1.0 / b + 1.0 / c + 1.0 / d) AS se
      FROM (SELECT COUNT(*) FILTER (WHERE x = 1 AND readmitted_30 = 1) AS a,
                   COUNT(*) FILTER (WHERE x = 1 AND readmitted_30 = 0) AS b,
                   COUNT(*) FILTER (WHERE x = 0 AND readmitted_30 = 1) AS c,
                   COUNT(*) FILTER (WHERE x = 0 AND readmitted_30 = 0) AS d
            FROM (SELECT readmitted_30, CASE WHEN discharge_group = 'Transferred/Other' THEN 1 ELSE 0 END AS x
                  FROM analytic)))"""),
    "q_group_scores": _w("""SELECT encounter_id, readmitted_30 AS label, ROUND(rate, 4) AS score
FROM split JOIN (SELECT diag1_group, AVG(readmitted_30) AS rate FROM split WHERE split = 'train' GROUP BY 1) USING (diag1_group)
WHERE split = 'test'"""),
    "q_group_metrics": _w(""", s AS (
  SELECT readmitted_30 AS label, ROUND(rate, 4) AS score FROM split
  JOIN (SELECT diag1_group, AVG(readmitted_30) AS rate FROM split WHERE split = 'train' GROUP BY 1) USING (diag1_group)
  WHERE split = 'test'),
steps AS (SELECT score, SUM(label) AS p, COUNT(*) AS n FROM s GROUP BY score)
SELECT (SELECT ROUND(AVG(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 6)
        FROM s a, s b WHERE a.label = 1 AND b.label = 0) AS auc,
       (SELECT ROUND(SUM(t.p / (SELECT SUM(p) FROM steps) * (SELECT SUM(u.p) / SUM(u.n) FROM steps u WHERE u.score >= t.score)), 6)
        FROM steps t) AS average_precision,
       (SELECT ROUND(AVG(label), 6) FROM s) AS prevalence"""),
    "q_group_odds": _w(""", t AS (SELECT diag1_group AS g, SUM(readmitted_30) AS a, SUM(1 - readmitted_30) AS b FROM analytic GROUP BY 1),
o AS (SELECT t.g, CAST(t.a AS DOUBLE) * r.b / (CAST(t.b AS DOUBLE) * r.a) AS ratio, SQRT(1.0 / t.a + 1.0 / t.b + 1.0 / r.a + 1.0 / r.b) AS se
      FROM t, t r WHERE r.g = (SELECT MIN(g) FROM t) AND t.g <> r.g)
SELECT 'diag1_group_' || g AS predictor, ROUND(ratio, 4) AS odds_ratio, ROUND(se, 4) AS std_error,
       repeat('*', (ABS(ln(ratio)) / se > 1.959963984540054)::INTEGER + (ABS(ln(ratio)) / se > 2.5758293035489004)::INTEGER
                   + (ABS(ln(ratio)) / se > 3.2905267314919255)::INTEGER) AS signif,
       CASE WHEN ratio > 1 THEN 'Increases risk' ELSE 'Decreases risk' END AS direction,
       ABS(ln(ratio)) / se > 1.959963984540054 AS significant
FROM o"""),
    "q_group_cv_auc": _w(""", tr AS (SELECT fold, diag1_group AS g, readmitted_30 AS y FROM split WHERE split = 'train'),
s AS (SELECT f.fold, f.y, (SELECT ROUND(AVG(o.y), 4) FROM tr o WHERE o.fold <> f.fold AND o.g = f.g) AS score FROM tr f)
SELECT p.fold, ROUND(AVG(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END), 6) AS auc
FROM s p JOIN s n ON p.fold = n.fold AND p.y = 1 AND n.y = 0 GROUP BY p.fold"""),
}
# The entries of the vectors are the scaled columns that another query gives and the
# dummies that aren't 0, of the test rows.
_ENTRIES_SQL = _w("""SELECT s.encounter_id, l.feature || '_' || l.level AS dummy, 1.0::DOUBLE AS value
FROM (UNPIVOT (SELECT encounter_id, """ + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in CATEGORICAL)
                  + """ FROM split) ON """ + ", ".join(CATEGORICAL) + """ INTO NAME feature VALUE value) s
JOIN (SELECT feature, level FROM (
        SELECT DISTINCT feature, level FROM (UNPIVOT (SELECT """
                  + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in CATEGORICAL)
                  + """ FROM split WHERE split = 'train') ON """ + ", ".join(CATEGORICAL)
                  + """ INTO NAME feature VALUE level))
      QUALIFY level <> MIN(level) OVER (PARTITION BY feature)) l ON s.feature = l.feature AND s.value = l.level""")
ORACLE["q_assembled"] = ("SELECT encounter_id, feature, value FROM (UNPIVOT (" + ORACLE["q_standardize"] + ") ON "
                         + ", ".join(NUMERIC) + " INTO NAME feature VALUE value) WHERE value <> 0 UNION ALL SELECT encounter_id, dummy, value FROM ("
                         + _ENTRIES_SQL + ") WHERE value <> 0 AND encounter_id IN (SELECT encounter_id FROM (" + ORACLE["q_attach"] + "))")

_LONG = lambda sql, tab, key, metrics: (
    f"SELECT '{tab}' AS tab, {key} AS key, metric, value FROM (UNPIVOT (SELECT *, {', '.join(f'{m}::DOUBLE AS v_{m}' for m in metrics)} FROM ({sql})) ON "
    + ", ".join(f"v_{m} AS {m}" for m in metrics) + " INTO NAME metric VALUE value)")
_GROUP_SCORES = ORACLE["q_group_scores"].split("\nSELECT encounter_id, readmitted_30 AS label")[-1]
_BUNDLE = ("WITH " + CHAIN_SQL + ", scores AS (SELECT encounter_id AS id, readmitted_30 AS label" + _GROUP_SCORES + ")" + scoring.TABLES_SQL)
_TAIL = lambda q: scoring.ORACLE[q][len("WITH " + scoring.SCORES_SQL + scoring.TABLES_SQL):]
ORACLE["q_bundle"] = (_BUNDLE + _LONG("""SELECT t.risk_tier, b.decile, COUNT(*) AS n, ROUND(SUM(round_even(t.score, 4)), 6) AS sum_prob, SUM(t.id) AS sum_ids
FROM tiered t JOIN binned b ON t.id = b.id GROUP BY 1, 2""", "scored", "decile || '/' || risk_tier", ["n", "sum_prob", "sum_ids"])
    + " UNION ALL " + _LONG(_TAIL("q_decile_summary"), "deciles", "decile::VARCHAR", ["n", "positives", "rate_pct", "capture_pct", "contacted_pct"])
    + " UNION ALL " + _LONG(_TAIL("q_kpi"), "kpi", "''", KPI)
    + " UNION ALL " + _LONG(ORACLE["q_group_odds"], "odds", "predictor", ["odds_ratio", "std_error"]))
