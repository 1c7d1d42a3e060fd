import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tarnlake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", 3)
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.codegen.wholeStage", "false")  # small inputs: compiling takes longer than running
    yield session
    session.stop()
