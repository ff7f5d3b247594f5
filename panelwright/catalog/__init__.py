"""Runnable queries over the data tables, grouped by subject."""

from panelwright.catalog import (  # noqa: F401
    attribution,
    cleaning,
    evaluation,
    files,
    missing,
    modelling,
    panels,
    profiles,
    reports,
    statistics,
    streams,
    validation,
)
from panelwright.catalog.registry import REGISTRY  # noqa: F401
