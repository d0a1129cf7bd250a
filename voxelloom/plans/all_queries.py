"""Importing the query modules fills the registry."""

from voxelloom.plans import (  # noqa: F401
    geometry_queries,
    mesh_queries,
    porosity_queries,
    scoring_queries,
    stencil_queries,
    synthetic_queries,
)
from voxelloom.plans.registry import CHECKS, QUERIES  # noqa: F401
