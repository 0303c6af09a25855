import pytest

from scanloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    yield s
    s.stop()
