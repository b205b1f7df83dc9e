import pytest

from textloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=8, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
