"""End-to-end cleaning of registers and yearly tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from panelwright import fixed_values as V
from panelwright.functions import categories as C, dates as D, numeric as N, parsing as P, text as T
from panelwright.operators.missing.chained import chained_impute
from panelwright.operators.missing.fill import fill_central
from panelwright.operators.panel import WIDE_COLUMN, decode, encode, label_codes, wide_to_panel
from panelwright.session import cut_lineage

DATE_COLUMNS = (
    "date_of_birth", "date_of_diagnosis", "date_of_notification", "treatment_start_date",
    "date_of_outcome", "intensive_phase_start_date", "intensive_phase_end_date",
    "continuation_phase_start_date", "continuation_phase_end_date",
)
CLINICAL_DATES = tuple(c for c in DATE_COLUMNS if c not in ("date_of_birth", "treatment_start_date"))
MAPPED = {
    "sex": V.SEX,
    "civil_status": V.CIVIL_STATUS,
    "diagnosis": V.DIAGNOSIS,
    "bacteriologic_status": V.BACTERIOLOGIC_STATUS,
    "treatment_regimen": V.REGIMEN,
    "outcome": V.OUTCOME,
    "case_registration_group": V.REGISTRATION_GROUP,
    "drug_resistance_bacteriological_status": V.DRUG_RESISTANCE,
    "regimen_type_at_start_of_treatment": V.REGIMEN_PHASE,
    "regimen_type_at_end_of_treatment": V.REGIMEN_PHASE,
}
REWRITTEN = {
    "co_morbidities": C.normalize_terms,
    "prior_history_of_tb": C.prior_history,
    "dat_supported": C.dosing_support,
    "chest_x_ray_at_case_notification": C.chest_film,
    "tuberculin_skin_test": C.null_misplaced,
}
PANEL_PARSERS = {
    "weight": lambda c: P.parse_measure(c, "kg"),
    "height": lambda c: P.parse_measure(c, "cm"),
    "pct_adherence": P.parse_proportion,
    "smear_tb_lamp": P.smear_result,
    "xpert_mtb_rif": P.xpert_result,
}


def parse_static(df: DataFrame) -> DataFrame:
    """Typed, repaired, bounded and harmonised columns; every column is optional.

    Dates are repaired in steps of their own: each repair mentions its date several times,
    and nesting them would multiply the expression.
    """
    have = set(df.columns)
    year = F.col("data_year") if "data_year" in have else F.lit(2025)
    dates = [c for c in DATE_COLUMNS if c in have]
    if dates:
        df = df.withColumns({c: F.trim(F.regexp_replace(c, r"[^0-9/\-]+$", "")) for c in dates})
        df = df.withColumns({c: D.parse_mixed_date(F.col(c)) for c in dates})
        repaired = {c: D.fix_future_year(F.col(c), year) for c in CLINICAL_DATES if c in have}
        if "date_of_birth" in have:
            repaired["date_of_birth"] = D.fix_birth_year(F.col("date_of_birth"), year)
        df = df.withColumns(repaired)
    if "treatment_start_date" in have and "date_of_diagnosis" in have:
        order = D.enforce_order(F.col("treatment_start_date"), F.col("date_of_diagnosis"))
        df = df.withColumn("treatment_start_date", order)
    out = {}
    if "weight" in have:
        out["weight_kg"] = P.parse_measure(F.col("weight"), "kg")
        out["weight"] = T.with_unit(out["weight_kg"], "kg")
    if "height" in have:
        out["height_cm"] = P.parse_measure(F.col("height"), "cm")
        out["height"] = T.with_unit(out["height_cm"], "cm")
    if "blood_pressure" in have:
        out["bp_systolic"], out["bp_diastolic"] = P.split_ratio(F.col("blood_pressure"))
    if "o2_sat" in have:
        out["o2_sat"] = P.parse_saturation(F.col("o2_sat"))
    if "xpert_mtb_rif" in have:
        out["xpert_mtb_rif"] = P.xpert_result(F.col("xpert_mtb_rif"))
    if "smear_microscopy" in have:
        out["smear_microscopy"] = P.smear_result(F.col("smear_microscopy"))
    for c in ("age", "heart_rate", "respiratory_rate", "temperature"):
        if c in have:
            out[c] = P.to_number(F.col(c))
    for c, bounds in V.STATIC_BOUNDS.items():
        if c in out:
            out[c] = N.clip(out[c], *bounds)
    if "age" in out:
        out["age"] = F.bround(out["age"], 0).cast("long")
    out.update({c: C.map_category(F.col(c), m) for c, m in MAPPED.items() if c in have})
    out.update({c: f(F.col(c)) for c, f in REWRITTEN.items() if c in have})
    if "nationality" in have:
        second = [C.nationality(F.col("nationality_raw"))] if "nationality_raw" in have else []
        out["nationality"] = F.coalesce(C.nationality(F.col("nationality")), *second)
    done = df.withColumns(out)
    return done.drop("nationality_raw") if "nationality" in have else done


def parse_panel(df: DataFrame) -> DataFrame:
    """Per-step columns of a wide table, of whatever step, as bounded numbers."""
    out = {}
    for found in filter(None, map(WIDE_COLUMN.match, df.columns)):
        name, metric = found.group(0), found.group(2)
        parser = PANEL_PARSERS.get(metric, P.to_number)
        out[name] = N.clip(parser(F.col(name)), *V.PANEL_BOUNDS.get(metric, (None, None)))
    return df.withColumns(out) if out else df


def clean_registers(raw: DataFrame, entity: str = "patient_id", key: str = "source_file") -> tuple[DataFrame, DataFrame]:
    """Raw register rows to (static, panel).

    The entity id is a hash of the row's full content and file with the row's number among
    those of that hash, so it does not depend on how the files were read, and equal rows, or
    rows whose hashes collide, are entities of their own. Identifier columns stay and are
    flagged by policy later.
    """
    numbered = with_content_ids(T.standardize_columns(raw), entity)
    return wide_to_panel(parse_panel(parse_static(numbered)), entity)


def with_content_ids(df: DataFrame, name: str, salts: int = 64) -> DataFrame:
    """Adds an id of the row's content and its number among rows of the same content hash.

    Rows are written once with a salt, so that the copies of a row that many rows repeat are
    numbered in ``salts`` parts of a window; the parts' sizes, added up, give where each starts.
    """
    content = [F.col(f"`{c}`") for c in sorted(df.columns)]
    keys = ["_ident", "_second", "_salt"]
    salted = cut_lineage(df.withColumns({
        "_ident": F.xxhash64(*content), "_second": F.xxhash64(F.lit(1), *content),
        "_salt": F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")}))
    before = Window.partitionBy("_ident").orderBy("_second", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).select(
        *keys, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    numbered = salted.withColumn("_no", F.row_number().over(Window.partitionBy(*keys).orderBy("_salt"))).join(starts, keys)
    ids = F.concat_ws("-", F.hex("_ident"), (F.col("_start") + F.col("_no")).cast("string"))
    return numbered.withColumn(name, ids).drop(*keys, "_no", "_start")


def yearly_features(df: DataFrame, year: str = "year") -> DataFrame:
    """Date parts, bounded intervals, merged age and graded results of a yearly table.

    Expects standardised column names and dates still as text.
    """
    have = set(df.columns)
    dates = (
        "date_of_screening", "date_of_diagnosis", "date_of_notification", "date_started_tx",
        "microscopy_release_date", "rdt_release_date", "birthdate",
    )
    out = df.withColumns({c: D.parse_mixed_date(F.col(c)) for c in dates if c in have})
    new = {}
    diagnosis = F.col("date_of_diagnosis")
    if "date_of_diagnosis" in have:
        out = out.select("*", *D.date_parts(diagnosis, "diagnosis"))
    spans = (
        ("days_to_treatment", "date_of_diagnosis", "date_started_tx", 0, 365),
        ("days_screening_to_diagnosis", "date_of_screening", "date_of_diagnosis", 0, 90),
        ("days_to_microscopy_result", "date_of_diagnosis", "microscopy_release_date", -7, 30),
        ("days_to_rdt_result", "date_of_diagnosis", "rdt_release_date", -7, 30),
    )
    for name, a, b, low, high in spans:
        if a in have and b in have:
            new[name] = D.interval_days(F.col(a), F.col(b), low, high)
    ages = []
    if "age" in have:
        ages.append(N.null_out_of_range(P.to_number(F.col("age")), 0, 110))
    if "birthdate" in have:
        ages.append(D.age_in_year(F.col("birthdate"), F.col(year)).cast("double"))
    if ages:
        new["age_final"] = F.coalesce(*ages)
    if "microscopy_result" in have:
        new["microscopy_result"] = C.microscopy_grade(F.col("microscopy_result"))
    if "rdt_result" in have:
        new["rdt_result"] = C.rapid_test(F.col("rdt_result"))
    gone = [c for c in (*dates, "age") if c in have]
    return out.withColumns(new).drop(*gone)


def impute_encoded(
    df: DataFrame,
    numeric: Sequence[str],
    texts: Sequence[str],
    bounds: Mapping[str, tuple[float, float]] | None = None,
    whole: Sequence[str] = (),
    rounds: int = 20,
) -> DataFrame:
    """Text as codes, chained linear imputation, bounds and rounding, text back again."""
    tables = {c: label_codes(df, c) for c in texts}
    coded = df
    for c, table in tables.items():
        coded = encode(coded, c, table)
    codes = [f"{c}_code" for c in texts]
    done = chained_impute(
        coded.withColumns({c: F.col(c).cast("double") for c in codes}),
        [*numeric, *codes], kind="linear", max_rounds=rounds,
    )
    fixed = {c: N.clip(F.col(c), *b) for c, b in (bounds or {}).items()}
    fixed.update({c: F.bround(fixed.get(c, F.col(c)), 0) for c in whole})
    done = done.withColumns(fixed) if fixed else done
    for c, table in tables.items():
        top = table.agg(F.max("code")).scalar()
        code = F.least(F.greatest(F.bround(F.col(f"{c}_code"), 0).cast("int"), F.lit(0)), top)
        done = decode(done.withColumn(f"{c}_code", code).drop(c), f"{c}_code", table, c).drop(f"{c}_code")
    return fill_central(done, list(texts)) if texts else done
