"""Registered queries: each has a Spark function and, where SQL can say it, an equivalent SQL text."""

from workload import cleaning, features, invariants, profiles, rows, sources, structure, text  # noqa: F401
from workload.base import ORACLES, QUERIES  # noqa: F401
