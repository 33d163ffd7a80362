import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))


@pytest.fixture(scope="session")
def spark():
    from quakeloom import session

    made = session.build("local[4]", 4, **{"spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.local.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp")})
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
