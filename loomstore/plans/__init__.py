"""The registry of the engine's queries and of their DuckDB twins."""

from . import lifecycle, tensors  # noqa: F401  they add their queries
from .relational import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
