import tempfile

import pytest

from concordis.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]",
        "concordis-tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
