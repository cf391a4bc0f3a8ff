import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tidewatch.session import local_session

    session = local_session(name="tidewatch-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from tidewatch.plans import catalogue  # noqa: F401  (fills the fixtures)
    from tidewatch.plans.fixtures import Tables

    return Tables(spark, "/root/testdata/sf0.001")
