import pytest

from stratakb.session import build


@pytest.fixture(scope="session")
def spark():
    session = build("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
