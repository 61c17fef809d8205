import pytest

from reachline.session import build_session, remove_work_paths


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("reachline-tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "6g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    remove_work_paths(session)
    session.stop()
