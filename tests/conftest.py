import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from satledger.session import build_session

    s = build_session("local[4]", app="satledger-tests", shuffle_partitions=4,
                      extra={"spark.sql.session.timeZone": "Asia/Tokyo"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
