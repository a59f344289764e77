"""All queries of the core library: importing their modules registers them."""

from boxwright.plans import annotation, construction, evaluation, io, reporting  # noqa: F401
from boxwright.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
