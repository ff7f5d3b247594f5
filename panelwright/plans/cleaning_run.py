"""Register files to a filled, bounded and checked dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from panelwright.operators.missing.handle import MissingResult, handle_missing
from panelwright.operators.missing.route import RouteConfig
from panelwright.operators.panel import join_static, panel_to_wide
from panelwright.operators.profile import quality_gates
from panelwright.plans.audit import audit_report, export_readable, watch, write_audit
from panelwright.plans.registry import clean_registers
from panelwright.sources import registers, sinks
from panelwright.spec import TableSpec


@dataclass
class CleaningRun:
    static: DataFrame
    panel: DataFrame
    missing: MissingResult
    gates: DataFrame
    report: dict
    export: DataFrame | None = None


def run_cleaning(
    spark: SparkSession,
    folder: str,
    out: str | None = None,
    spec: TableSpec = TableSpec(),
    config: RouteConfig = RouteConfig(hard_drop=0.90, impute_importance_pct=30),
    **options,
) -> CleaningRun:
    """Reads, cleans, diagnoses and fills; with ``out`` also exports.

    The cleaned pair is written once before the missing-data passes, which read it many
    times; counts before and after come from one pass over each. Exports: the wide readable
    table as CSV, checked against the table, the panel as Parquet, the decisions as JSON and
    the audit report with its manifest, which is written last.
    """
    static, panel = clean_registers(registers.read_registers(spark, folder), spec.entity)
    columns = spec.present(static, (*spec.measures, *spec.categories))
    metrics = spec.present(panel, spec.metrics)
    kept = [spec.entity, *columns]
    before = {"static": watch(static.select(*kept)), "panel": watch(panel.select(spec.entity, spec.step, *metrics))}
    done = handle_missing(
        before["static"].table, before["panel"].table, spec.entity, columns, metrics,
        label=spec.label if spec.label in columns else None, step=spec.step, config=config, **options,
    )
    after = {"static": watch(done.static), "panel": watch(done.panel)}
    filled, steps = after["static"].table, after["panel"].table
    facts = [{name: w.facts for name, w in side.items()} for side in (before, after)]
    report = audit_report(done, *facts, {"hard_drop": config.hard_drop, **{k: v for k, v in options.items()}})
    export = None
    if out:
        left = [c for c in steps.columns if c not in (spec.entity, spec.step)]
        wide = join_static(filled, panel_to_wide(steps, spec.entity, left, step=spec.step), spec.entity)
        export = export_readable(wide, f"{out}/wide", spec.entity)
        sinks.write_parquet(steps, f"{out}/panel")
        sinks.write_report(done.decisions, f"{out}/decisions")
        write_audit(spark, report, f"{out}/audit")
    return CleaningRun(filled, steps, done, quality_gates(filled, spec.identifiers), report, export)
