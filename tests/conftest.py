import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


def session():
    from assayer.session import build_session
    spark = build_session(
        "assayer-tests", "local[8]", spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g",
        spark__sql__warehouse__dir="/tmp/assayer-warehouse")
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    yield session()
