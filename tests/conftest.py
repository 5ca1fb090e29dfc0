import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from objectlake.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = ship(local_session(8, "6g"))
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
