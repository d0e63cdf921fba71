import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("TALLYRUN_DRIVER_MEMORY", "6g")


@pytest.fixture(scope="session")
def spark():
    from tallyrun.session import build_session

    s = build_session("tests", 4)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    return s
