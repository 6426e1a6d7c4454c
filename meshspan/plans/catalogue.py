"""All registered queries of the planning engine."""

from . import access, chains, details, flows, geodesy, land, links, network, planning, polygons, records, stores, terrain_queries, views, warmup  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
