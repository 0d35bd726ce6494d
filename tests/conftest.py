import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from changeflow.session import local_session, work_dir  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4, **{"spark.ui.showConsoleProgress": "false"})
    yield session
    session.stop()


@pytest.fixture
def folder(spark):
    """A fresh folder, in the shared one if the session names it."""
    return work_dir(spark, "test")


@pytest.fixture
def conf(spark):
    """Set Spark options for one test."""
    before = {}

    def set_options(**options):
        for key, value in options.items():
            key = key.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield set_options
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
