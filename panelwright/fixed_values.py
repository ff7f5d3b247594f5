"""Vocabularies, lookup tables and bounds that results depend on."""

# ---------------------------------------------------------------------------
# Lookup tables (keys are compared trimmed and lower-cased)
# ---------------------------------------------------------------------------
SEX = {"m": "Male", "male": "Male", "f": "Female", "female": "Female"}

CIVIL_STATUS = {
    "s": "Single", "single": "Single",
    "m": "Married", "married": "Married",
    "w": "Widowed", "widow": "Widowed", "widowed": "Widowed",
    "sep": "Separated", "separated": "Separated",
}

DIAGNOSIS = {"tb disease": "TB Disease", "tb infection": "TB Infection"}

BACTERIOLOGIC_STATUS = {
    "bc": "Bacteriologically Confirmed",
    "bacteriologically confirmed": "Bacteriologically Confirmed",
    "bacteriologically-confirmed tb": "Bacteriologically Confirmed",
    "bacteriologically- confirmed tb": "Bacteriologically Confirmed",
    "bacteriologically -confirmed tb": "Bacteriologically Confirmed",
    "bacteriologically- confirmed ptb": "Bacteriologically Confirmed",
    "bacteriologically confirmed tb": "Bacteriologically Confirmed",
    "cd": "Clinically Diagnosed",
    "clinically diagnosed": "Clinically Diagnosed",
    "clinically-diagnosed tb": "Clinically Diagnosed",
    "clinically diagnosed tb": "Clinically Diagnosed",
}

REGIMEN = {
    "1": "Regimen 1", "1.0": "Regimen 1",
    "2": "Regimen 2", "2.0": "Regimen 2",
    "regimen 1": "Regimen 1", "regimen i": "Regimen 1",
    "cat 1": "Regimen 1", "i": "Regimen 1",
    "regimen 2": "Regimen 2",
    "1a": "Regimen 1a", "ia": "Regimen 1a",
    "hrze": "Regimen 1", "2hrze*/4hr": "Regimen 1",
    "2hrze/4hr": "Regimen 1", "2hrze*4hr": "Regimen 1",
    "2hrze 4hr": "Regimen 1",
}

REGIMEN_PHASE = {
    "1": "Regimen 1", "regimen 1": "Regimen 1", "cat 1": "Regimen 1",
    "2": "Regimen 2", "regimen 2": "Regimen 2",
    "1a": "Regimen 1a",
}

OUTCOME = {
    "cured": "Cured",
    "treatment completed": "Treatment Completed",
    "tx completed": "Treatment Completed",
    "treatment complete": "Treatment Completed",
    "lost to follow-up": "Lost to Follow-Up",
    "lost to follow up": "Lost to Follow-Up",
    "ltfu": "Lost to Follow-Up",
    "died": "Died",
    "not evaluated - transferred": "Not Evaluated",
    "not evaluated": "Not Evaluated",
    "transferred out": "Not Evaluated",
    "treatment failure": "Treatment Failure",
}

REGISTRATION_GROUP = {
    "new": "New", "relapse": "Relapse",
    "talf": "Treatment After Lost to Follow-Up",
    "taf": "Treatment After Failure",
}

DRUG_RESISTANCE = {
    "drug-susceptible": "Drug Susceptible",
    "dstb": "Drug Susceptible",
    "drug susceptible": "Drug Susceptible",
    "drg susceptible": "Drug Susceptible",
    "clinically - diagnosed mdr-tb": "MDR-TB",
    "bacteriologically confirmed mdr-tb": "MDR-TB",
    "bc-mdr tb": "MDR-TB",
}

MICROSCOPY = {
    "0": "Negative", "(nothing)": "Negative", "negative": "Negative",
    "+": "Scanty", "(+)": "Scanty", "+n ()": "Scanty", "scanty": "Scanty",
    "1+": "1+", "2+": "2+", "3+": "3+",
    "not done": "Not Done", "odt": "Not Done",
}

COMORBIDITY_TERMS = {
    "diabetes mellitus": "Diabetes Mellitus",
    "diabetes": "Diabetes Mellitus",
    "dm": "Diabetes Mellitus",
    "prediabetic": "Prediabetic",
    "hypertension": "Hypertension",
    "htn": "Hypertension",
    "elevated bp": "Hypertension",
    "cancer": "Cancer",
    "ckd": "Chronic Kidney Disease",
    "chronic kidney disease": "Chronic Kidney Disease",
    "renal disease": "Chronic Kidney Disease",
    "kidney": "Chronic Kidney Disease",
    "diabetic kidney disease": "Diabetic Kidney Disease",
    "cardiovascular disease": "Cardiovascular Disease",
    "cad": "Coronary Artery Disease",
    "chronic coronary syndrome": "Coronary Artery Disease",
    "acute coronary syndrome": "Coronary Artery Disease",
    "copd": "COPD",
    "chronic obstructive pulmonary disease": "COPD",
    "bronchial asthma": "Asthma",
    "asthma": "Asthma",
    "hiv": "HIV",
    "anemia": "Anemia",
    "arthritis": "Arthritis",
    "hypothyroidism": "Hypothyroidism",
    "hydrocephalus secondary": "Hydrocephalus",
    "benign prostatic hyperplasia": "Benign Prostatic Hyperplasia",
    "cellulitis": "Cellulitis",
    "skin allergy": "Skin Allergy",
}
COMORBIDITY_NONE = ("no known", "none", "n/a")
COMORBIDITY_NONE_LABEL = "No Known Comorbidity"

# ---------------------------------------------------------------------------
# Result vocabularies
# ---------------------------------------------------------------------------
SMEAR_NEGATIVES = (
    "0", "negative", "negataive", "neg", "not detected", "no afb seen", "n", "nd",
    "mtb not det", "mtb nd", "n (not detected)", "mtb not detected",
)
XPERT_NEGATIVES = (
    "not detected", "mtb not det", "mtb nd", "mtb not detected", "n (not detected)",
    "negative", "n", "nd", "0",
)
LENIENT_NEGATIVES = (
    "negative", "not detected", "mtb not det", "no afb seen", "n", "nd", "mtb nd",
    "neg", "negataive", "mtb not detected",
)
LENIENT_POSITIVES = (
    "positive", "detected", "mtb detected", "mtb det", "1+", "2+", "3+", "scanty",
    "trace", "p",
)
RDT_NEGATIVE_WORDS = ("not detected", "negative", "non-reactive", "no mtb")
RDT_POSITIVE_WORDS = ("detected", "positive", "reactive")

SATURATION_SENTINELS = ("n/a", "na", "nan", "")
MISPLACED_FILM_PATTERN = "atelectasis|infiltrate|opacity|mass"

SUCCESS_OUTCOMES = ("Cured", "Treatment Completed")
STATIC_SUCCESS = ("TREATMENT COMPLETED", "CURED")
STATIC_FAILURE = ("DIED", "LOST TO FF-UP", "FAILED")

# ---------------------------------------------------------------------------
# Plausible ranges (low, high)
# ---------------------------------------------------------------------------
STATIC_BOUNDS = {
    "age": (0, 110),
    "weight_kg": (10, 180),
    "height_cm": (80, 220),
    "bp_systolic": (60, 220),
    "bp_diastolic": (30, 140),
    "heart_rate": (20, 250),
    "respiratory_rate": (4, 60),
    "temperature": (30, 45),
    "o2_sat": (70, 100),
}
PANEL_BOUNDS = {
    "weight": (10, 180),
    "height": (80, 220),
    "pct_adherence": (0, 1),
    "monthly_doses_taken": (0, 31),
    "monthly_missed_doses": (0, None),
    "smear_tb_lamp": (0, 1),
    "xpert_mtb_rif": (0, 1),
}
PANEL_STEPS = tuple(range(13))
CUMULATIVE_COLUMN = "cumulative_doses_taken"

# ---------------------------------------------------------------------------
# Calendars and bands
# ---------------------------------------------------------------------------
SEASON_LOCAL = {
    12: "Tag-lamig", 1: "Tag-lamig", 2: "Tag-lamig",
    3: "Tag-init", 4: "Tag-init", 5: "Tag-init",
    6: "Tag-ulan", 7: "Tag-ulan", 8: "Tag-ulan",
    9: "Tag-ulan", 10: "Tag-ulan", 11: "Tag-ulan",
}
SEASON_FOUR = {
    12: "Winter", 1: "Winter", 2: "Winter",
    3: "Spring", 4: "Spring", 5: "Spring",
    6: "Summer", 7: "Summer", 8: "Summer",
    9: "Fall", 10: "Fall", 11: "Fall",
}
MODEL_RISK_CUTS = (0.7, 0.4)
DASHBOARD_RISK_CUTS = (0.6, 0.35)
PROBABILITY_CEILING = 0.95
ADHERENCE_FULL = 0.9
ADHERENCE_PARTIAL = 0.5
TREND_DELTA = 0.05

# ---------------------------------------------------------------------------
# Registry file layout
# ---------------------------------------------------------------------------
FIRST_STEP_HEADER = "Month 0"
FACILITY_ALIASES = {
    "atoktrail": "Atok Trail",
    "atok trail": "Atok Trail",
    "pacdal": "Pacdal",
    "pinsao": "Pinsao",
    "mines view": "Mines View",
    "eng hill": "Eng Hill",
}
RENAMED_HEADERS = {"DAT- supported": "dat_supported_dup", "Nationality": "nationality_raw"}

# ---------------------------------------------------------------------------
# Columns kept out of model features
# ---------------------------------------------------------------------------
IDENTIFIER_COLUMNS = (
    "no", "source_file", "name_of_diagnosing_facility", "name_of_treatment_unit",
)
LEAKAGE_COLUMNS = (
    "data_year", "source_file", "date_of_outcome", "is_missing_outcome", "no",
    "name_of_diagnosing_facility", "name_of_treatment_unit", "date_of_birth",
    "regimen_type_at_end_of_treatment", "regimen_type_at_6th_month_of_treatment",
    "intensive_phase_end_date", "continuation_phase_start_date",
    "continuation_phase_end_date", "blood_pressure", "height", "weight",
    "tuberculosis_culture", "tuberculin_skin_test", "other_lab_test", "other", "others",
    "dat_supported_dup", "risk_factors_for_drug_resistance_tuberculosis", "facility",
)
REMOVED_STATIC_COLUMNS = (
    "sex", "civil_status", "nationality", "treatment_regimen", "co_morbidities",
    "drug_resistance_bacteriological_status", "chest_x_ray_at_case_notification",
    "diagnosis", "bacteriologic_status", "case_registration_group",
)

# ---------------------------------------------------------------------------
# Explanation vocabulary, in matching order
# ---------------------------------------------------------------------------
KNOWN_FEATURES = (
    "Drug Resistance Status", "Missing Indicators", "Days To Treatment",
    "Registration Group", "Case Registration Group", "Bacteriologic Status",
    "Bacteriological Status", "Microscopy Result", "Smear Microscopy",
    "Treatment Adherence", "Treatment Regimen", "Body Weight", "Smear Result",
    "Smear/TB Lamp", "TB Lamp", "Xpert Result", "Xpert MTB/RIF", "Monthly Doses",
    "Cumulative Doses", "Missed Doses", "Months Available", "Vital Signs",
    "Site Factors", "Chest X-Ray", "Chest Xray", "Chest X Ray", "Civil Status",
    "Diagnosis Type", "Comorbidities", "Nationality", "Dates", "Age", "Sex", "Height",
)
INCREASE_PHRASES = (
    "strongly increases", "significantly increases", "increases", "increase",
    "raises", "raise", "higher", "elevates", "elevate",
)
DECREASE_PHRASES = (
    "strongly reduces", "significantly reduces", "reduces", "reduce", "decreases",
    "decrease", "lowers", "lower", "declines", "decline",
)
MIXED_PHRASES = (
    "mixed effect", "mixed", "both increased and decreased", "varied", "variable",
    "inconsistent",
)
MAGNITUDE_WORDS = (
    ("strongly", "strong"), ("significantly", "strong"), ("strong", "strong"),
    ("moderately", "moderate"), ("moderate", "moderate"),
    ("slightly", "weak"), ("weakly", "weak"), ("weak", "weak"),
)
CLAIM_CONTEXT_CHARS = 250
CASE_WEIGHTS = {"feature_f1": 0.45, "sign_accuracy": 0.35, "magnitude_accuracy": 0.20}
CASE_GATES = {
    "feature_f1": 0.60, "sign_accuracy": 0.60, "magnitude_accuracy": 0.50, "composite": 0.60,
}
STRONG_SHARE = 0.30

# Raw name -> reporting group of a model feature
FEATURE_GROUPS = {
    "pct_adherence": "Treatment_Adherence",
    "weight": "Body_Weight",
    "height": "Height",
    "monthly_doses_taken": "Monthly_Doses",
    "cumulative_doses_taken": "Cumulative_Doses",
    "monthly_missed_doses": "Missed_Doses",
    "smear_tb_lamp": "Smear_Result",
    "xpert_mtb_rif": "Xpert_Result",
    "months_available": "Months_Available",
    "age": "Age",
    "days_to_treatment": "Days_To_Treatment",
    "bp_systolic": "Vital_Signs",
    "bp_diastolic": "Vital_Signs",
    "heart_rate": "Vital_Signs",
    "o2_sat": "Vital_Signs",
    "height_cm": "Height",
    "weight_kg": "Body_Weight",
    "smear_microscopy": "Microscopy_Result",
    "date_of_diagnosis": "Dates",
    "date_of_notification": "Dates",
    "treatment_start_date": "Dates",
    "intensive_phase_start_date": "Dates",
}
ONE_HOT_GROUPS = {
    "sex_": "Sex",
    "bacteriologic_status_": "Bacteriologic_Status",
    "registration_group_": "Registration_Group",
    "case_registration_group_": "Registration_Group",
    "smear_microscopy_": "Microscopy_Result",
    "facility_": "Site_Factors",
    "civil_status_": "Civil_Status",
    "diagnosis_": "Diagnosis_Type",
    "drug_resistance_bacteriological_status_": "Drug_Resistance_Status",
    "chest_x_ray_at_case_notification_": "Chest_Xray",
    "treatment_regimen_": "Treatment_Regimen",
    "nationality_": "Nationality",
    "co_morbidities_": "Comorbidities",
    "name_of_treatment_unit_": "Site_Factors",
    "name_of_diagnosing_facility_": "Site_Factors",
}
MISSING_GROUP = "Missing_Indicators"

# Spoken name (lower case, spaces) -> reporting group; the group's own name in
# words always maps to itself
FEATURE_ALIASES = {
    "gender": "Sex",
    "time to treatment": "Days_To_Treatment",
    "case registration group": "Registration_Group",
    "bacteriological status": "Bacteriologic_Status",
    "smear microscopy": "Microscopy_Result",
    "adherence": "Treatment_Adherence",
    "% adherence": "Treatment_Adherence",
    "pct adherence": "Treatment_Adherence",
    "weight": "Body_Weight",
    "smear/tb lamp": "Smear_Result",
    "tb lamp": "Smear_Result",
    "xpert mtb/rif": "Xpert_Result",
    "observation period": "Months_Available",
    "chest x-ray": "Chest_Xray",
    "co-morbidities": "Comorbidities",
    "diagnosis": "Diagnosis_Type",
    "drug resistance": "Drug_Resistance_Status",
    "facility": "Site_Factors",
    "treatment facility": "Site_Factors",
    "drug regimen": "Treatment_Regimen",
    "vitals": "Vital_Signs",
}
CANONICAL_FEATURES = (
    "Age", "Sex", "Days_To_Treatment", "Registration_Group", "Bacteriologic_Status",
    "Microscopy_Result", "Treatment_Adherence", "Body_Weight", "Height", "Smear_Result",
    "Xpert_Result", "Monthly_Doses", "Cumulative_Doses", "Missed_Doses",
    "Months_Available", "Chest_Xray", "Civil_Status", "Comorbidities", "Dates",
    "Diagnosis_Type", "Drug_Resistance_Status", "Missing_Indicators", "Nationality",
    "Site_Factors", "Treatment_Regimen", "Vital_Signs",
)
