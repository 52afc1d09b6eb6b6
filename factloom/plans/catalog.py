"""Importing this module registers every query."""

from factloom.plans import dedup, extraction, linking, merging, quality, relations, reports, review, sources, streaming, text  # noqa: F401
from factloom.plans.registry import all_queries, all_sql  # noqa: F401
