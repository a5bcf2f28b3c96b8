"""Every registered query; importing this package fills the registry."""

from rolecall.plans import discovery, lookups, maintenance, matching, pages, scalars, streams  # noqa: F401
from rolecall.plans.registry import ORACLES, QUERIES  # noqa: F401
