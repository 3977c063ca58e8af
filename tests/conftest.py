import os

import pytest

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
ROWS_FOLDER = os.environ.get("TEST_ROWS_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tablewise.session import local_session

    session = local_session(min(8, os.cpu_count() or 2))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    from tests.compare import connect

    return connect(FOLDER)


@pytest.fixture(scope="session")
def tables(spark):
    from tablewise.plans.registry import Tables

    return Tables(spark, FOLDER)
