"""Imports every query module, so that CATALOGUE is complete."""

from macrospark.plans import (  # noqa: F401
    queries_basic, queries_composite, queries_learning, queries_learning_checked, queries_models, queries_seasonal, queries_stats, queries_streaming, queries_windows,
)
from macrospark.plans.catalogue import CATALOGUE

__all__ = ["CATALOGUE"]
