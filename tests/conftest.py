import pytest

from panelspark.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from panelspark.plans.fixtures import Tables

    return Tables(spark, SF)
