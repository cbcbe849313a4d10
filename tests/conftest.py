import os
import sys
from decimal import Decimal

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from harness import duck, spark_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return spark_session(memory="8g")


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def con(sf):
    return duck(sf)


@pytest.fixture
def make(spark):
    """Rows as a DataFrame: ``make("vn string, n int", ("a", 1))``."""

    def build(schema: str, *rows: tuple):
        kinds = T.StructType.fromDDL(schema)
        money = [isinstance(f.dataType, T.DecimalType) for f in kinds]
        exact = [tuple(Decimal(v) if m and v is not None else v for m, v in zip(money, r)) for r in rows]
        return spark.createDataFrame(exact, kinds)

    return build
