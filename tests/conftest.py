import os
import tempfile

import pytest

from timelane.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "timelane-tests",
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.sql.warehouse.dir": os.path.join(tempfile.mkdtemp(), "warehouse"),
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
