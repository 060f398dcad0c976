"""All registered queries."""
from gridfold.plans import scoring, topology, review, regions, quality, parcels, exports  # noqa: F401
from gridfold.plans.registry import ORACLES, QUERIES  # noqa: F401
