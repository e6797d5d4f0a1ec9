"""The queries that can be run on the driver's tables."""

from hubmetrics.queries import loading, names, shapes, stations, upkeep  # noqa: F401
from hubmetrics.queries.registry import ORACLES, QUERIES  # noqa: F401
