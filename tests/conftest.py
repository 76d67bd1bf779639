import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from takeoff.session import local_session

    session = local_session("4", "takeoff-tests", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column expression on a single row."""

    def value(expr, **cols):
        from pyspark.sql import functions as F

        df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
        return df.select(expr.alias("x")).first()["x"]

    return value
