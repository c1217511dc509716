"""All registered queries."""

from __future__ import annotations

from pavesa.plans import refine_queries  # noqa: F401  isort: skip
from pavesa.plans import spatial_queries  # noqa: F401  isort: skip
from pavesa.plans import scalar_queries  # noqa: F401  isort: skip
from pavesa.plans import raster_queries  # noqa: F401  isort: skip
from pavesa.plans import report_queries  # noqa: F401  isort: skip
from pavesa.plans import tile_queries  # noqa: F401  isort: skip
from pavesa.plans import ingest_queries  # noqa: F401  isort: skip
from pavesa.plans.registry import QUERIES, SQL  # noqa: F401
