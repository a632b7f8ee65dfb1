import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from factloom.session import local_session

    # tables of a few rows: tasks and compiled code cost more than the rows
    session = local_session(8, 2, **{"spark.default.parallelism": "2", "spark.sql.codegen.wholeStage": "false", "spark.sql.adaptive.enabled": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
