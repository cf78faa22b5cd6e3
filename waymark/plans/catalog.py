"""All queries that are registered by the modules of this package."""

from . import matching, registers, served  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
