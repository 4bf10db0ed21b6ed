import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from clickflow.session import local_session

    ckpt = tempfile.mkdtemp(prefix="clickflow-test-ckpt-")
    s = local_session("*", shuffle_partitions=8, app_name="clickflow-tests",
                      extra={"spark.checkpoint.dir": ckpt, "spark.sql.maxMetadataStringLength": "10000"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables001(spark):
    from clickflow_fixtures.adapter import ga4_tables

    return ga4_tables(spark, SF001)


@pytest.fixture(scope="session")
def tables01(spark):
    from clickflow_fixtures.adapter import ga4_tables

    return ga4_tables(spark, SF01)


def rows(df, order=None):
    """Collected rows as dicts, sorted for order-insensitive comparison."""
    out = [r.asDict(recursive=True) for r in df.collect()]
    key = order or (lambda r: tuple((v is None, str(v)) for v in r.values()))
    return sorted(out, key=key)
