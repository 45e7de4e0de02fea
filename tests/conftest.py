import os
import sys
import tempfile

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
# Python workers import the tests' own classes by name.
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, f"{HERE}/llm", *filter(None, [os.environ.get("PYTHONPATH")])])

from resemblage.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    place = tempfile.mkdtemp()
    session = local_session("tests", 4, 4, **{"spark.sql.warehouse.dir": f"file://{place}/warehouse", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
