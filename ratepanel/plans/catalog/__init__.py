"""Queries over the given tables, one per operator."""

from ratepanel.plans.catalog import boosting, evaluation, feature_set, inputs, learning, preparation, scoring  # noqa: F401
from ratepanel.plans.catalog.registry import ORACLES, QUERIES  # noqa: F401
