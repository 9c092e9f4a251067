import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from labelgrove.session import get_session
    session = get_session("tests", "local[8]", {
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "6g", "spark.local.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp")})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
