import os, sys
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from gleanery.session import build_session

    os.environ["PYTHONPATH"] = sys.path[0] + ":" + os.environ.get("PYTHONPATH", "")
    s = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "3g",
        "spark.sql.warehouse.dir": "/tmp/gleanery-warehouse"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
