"""Registered queries of the spatial operators, with the SQL that checks them."""

from . import aggregates, geometry, joins, ordered, solving, stores, volumes  # noqa: F401
from ._base import ORACLES, QUERIES  # noqa: F401
