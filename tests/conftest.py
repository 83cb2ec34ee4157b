import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sievewright.session import build_session

    warehouse = tmp_path_factory.mktemp("warehouse")
    session = build_session("tests", **{"spark.sql.warehouse.dir": str(warehouse), "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
