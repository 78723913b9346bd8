import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from barspark.session import local_session

    return local_session(8, "barspark-tests")


@pytest.fixture(scope="session")
def bars(spark):
    from barspark.sources.fixtures import lineitem_bars

    return lineitem_bars(spark, SF)


@pytest.fixture(scope="session")
def features(spark):
    from barspark.plans import load
    from barspark.plans.features import features as make

    load()
    return make(spark, SF)
