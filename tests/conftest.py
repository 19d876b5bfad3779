import pytest

from citeloom.session import ROCKSDB_PROVIDER, build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "citeloom-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
