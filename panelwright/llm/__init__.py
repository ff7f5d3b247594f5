"""Operators of a training-data pipeline, their queries and the SQL beside them."""

from panelwright.llm.queries import QUERIES, SQL  # noqa: F401
