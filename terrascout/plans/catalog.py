"""All registered queries."""

from terrascout.plans import (aggregates, chain, clusters, joins, learned, ranks, resources, sampling,  # noqa: F401
                              scalars, sources)
from terrascout.plans.fixtures import ORACLES, QUERIES  # noqa: F401
