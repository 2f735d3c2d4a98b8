import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("FOLIOSPARK_DRIVER_MEMORY", "4g")

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from foliospark.session import ensure_checkpoint_dir, local_session, ship_package

    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    ensure_checkpoint_dir(session)
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny():
    path = DATA / "sf0.001"
    if not path.exists():
        pytest.skip("no test tables here")
    return str(path)
