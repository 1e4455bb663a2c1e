"""All reference queries: importing the modules registers them."""

from . import blocks, cells, extensions, formulas, sources, text  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
