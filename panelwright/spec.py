"""Declared roles of a register's columns, so that behaviour never hangs on inferred types."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class TableSpec:
    """Which columns are keys, measures, categories and per-step metrics, and the label."""

    entity: str = "patient_id"
    step: str = "step"
    label: str | None = "outcome"
    measures: tuple[str, ...] = (
        "age", "weight_kg", "height_cm", "bp_systolic", "bp_diastolic", "heart_rate",
        "respiratory_rate", "temperature", "o2_sat", "xpert_mtb_rif", "smear_microscopy",
    )
    categories: tuple[str, ...] = (
        "sex", "civil_status", "nationality", "diagnosis", "bacteriologic_status",
        "treatment_regimen", "outcome", "case_registration_group",
        "drug_resistance_bacteriological_status", "co_morbidities", "prior_history_of_tb",
        "dat_supported", "chest_x_ray_at_case_notification",
    )
    metrics: tuple[str, ...] = (
        "monthly_doses_taken", "cumulative_doses_taken", "monthly_missed_doses",
        "pct_adherence", "weight", "height", "smear_tb_lamp", "xpert_mtb_rif",
    )
    identifiers: tuple[str, ...] = field(
        default=("no", "source_file", "name_of_diagnosing_facility", "name_of_treatment_unit")
    )

    def present(self, df: DataFrame, names: tuple[str, ...]) -> list[str]:
        return [n for n in names if n in df.columns]
