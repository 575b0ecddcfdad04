"""All registered queries of the library."""

from pointloom.plans import derived_queries, grid_queries, matrix_queries, more_queries, other_queries, point_queries  # noqa: F401
from pointloom.plans.registry import QUERIES, SQL  # noqa: F401
