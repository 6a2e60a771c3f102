import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 8g pyspark-shell")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from scriptorium.session import get_session
    s = get_session("local[8]", 8)
    if not s.conf.get("spark.checkpoint.dir", None):
        folder = str(tmp_path_factory.mktemp("checkpoints"))
        s.conf.set("spark.checkpoint.dir", folder)
        s.sparkContext.setCheckpointDir(folder)
    yield s
