import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
for p in (ROOT, ROOT / "tests"):
    if str(p) not in sys.path:
        sys.path.insert(0, str(p))


@pytest.fixture(scope="session")
def spark():
    from duelframe.session import build_session
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def setting(spark):
    """Set session values for one test."""
    changed = []

    def set_(key, value):
        changed.append(key)
        spark.conf.set(key, str(value))
    yield set_
    for key in changed:
        spark.conf.unset(key)


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def t(spark):
    from duelframe.plans.tables import tables
    return tables(spark, SF)


def rows(df, *order):
    return sorted((tuple(r) for r in df.select(*(order or df.columns)).collect()), key=str)
