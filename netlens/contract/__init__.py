"""Registered queries over the test tables and their SQL oracles."""

from netlens.contract import (  # noqa: F401
    aggregates,
    filters,
    flows,
    jobs,
    joins,
    parsing,
    policies,
    scalars,
    search,
    sources,
    stats,
    threats,
)
from netlens.contract.registry import ORACLES, QUERIES  # noqa: F401
