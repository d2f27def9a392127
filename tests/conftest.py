import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from emberlog.session import get_session

    session = get_session("local[4]", 4, **{"spark.driver.memory": "3g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lines_of(spark):
    def make(lines, file="f"):
        return spark.createDataFrame([(file, i + 1, x) for i, x in enumerate(lines)], "file string, line_no long, line string")

    return make
