from timelane.plans import (  # noqa: F401
    catalogs,
    expressions,
    keyframes,
    mixes,
    overlaps,
    records,
    snapshots,
    states,
    streams,
)
from timelane.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
