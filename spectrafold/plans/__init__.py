"""Registered queries: import every plan module, then read the registry."""

from . import conditioning, factorising, mosaicking, regions, seeding, sourcing, spatial, streamed, suggesting, unmixing  # noqa: F401
from .registry import ORACLES, QUERIES
from .unmixing import flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
