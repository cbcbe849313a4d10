"""Claim pre-check analytics on Spark.

Hospital tables come in as DataFrames (:class:`claimlens.sources.tables.Tables`),
operators compose lazy plans over them, and Catalyst plans the work.
"""

from claimlens.params import Params
from claimlens.sources.tables import Tables, load_jdbc, load_parquet

__all__ = ["Params", "Tables", "load_jdbc", "load_parquet"]
