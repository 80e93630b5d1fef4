import pytest

from gleanery.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, **{"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
