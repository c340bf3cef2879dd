import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import build_session

    s = build_session("local[4]", app="tidemark-tests", shuffle_partitions=4)
    yield s


def series_df(spark, rows, extra_cols=()):
    """rows: list of (series_id, 'YYYY-mm-dd HH:MM:SS', price, ...)."""
    import datetime as dt

    from pyspark.sql import types as T

    fields = [
        T.StructField("series_id", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("price", T.DoubleType()),
    ] + [T.StructField(c, T.DoubleType()) for c in extra_cols]
    data = [(r[0], dt.datetime.fromisoformat(r[1]), *[None if v is None else float(v) for v in r[2:]]) for r in rows]
    return spark.createDataFrame(data, T.StructType(fields))
