import pytest

from tests.conftest import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session()
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    yield spark
