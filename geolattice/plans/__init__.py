"""The queries of the library: importing it registers them all."""

from geolattice.plans import access, chain, iterative, judged, masks, overlays, raster, rasterfiles, seasons, territory, units  # noqa: F401
from geolattice.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
