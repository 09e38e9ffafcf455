import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from placeweave.session import get_spark

    SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8") \
        .config("spark.ui.enabled", "false").getOrCreate()
    session = get_spark(shuffle_partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session


def rows(df, *cols):
    """Collect ``df`` as a list of tuples (in its own order)."""
    sel = df.select(*cols) if cols else df
    return [tuple(r) for r in sel.collect()]
