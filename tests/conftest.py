import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from packetloom.session import build_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("packetloom-tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.log.level": "ERROR"})
    yield session
    session.stop()


@pytest.fixture
def small_chunks(spark):
    """Force the chunked scans on small tables."""
    spark.conf.set("packetloom.rowsPerChunk", "37")
    yield
    spark.conf.unset("packetloom.rowsPerChunk")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
