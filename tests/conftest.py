from __future__ import annotations

import pytest

from codeloom.session import local_session

# hundreds of different plans over a few rows: compiling them takes longer than running them
INTERPRETED = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores="4", partitions=4, app="codeloom-tests", more=INTERPRETED)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
