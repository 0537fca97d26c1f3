"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the blueprint, each running a library job over the whole driver
tables (bound to the logical views where the job expects them)."""

from quarry.catalog import analysis, catalogue, metrics, storage  # noqa: F401  (registration)
from quarry.catalog.base import REGISTRY, query  # noqa: F401
