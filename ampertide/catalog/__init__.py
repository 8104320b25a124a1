"""Registered queries over the driver tables, each with its check SQL."""

from .registry import CHECKS, QUERIES  # noqa: F401
from . import tape, features, curves, panel, stats, functions, reports, models, plans, sources  # noqa: F401, E402
