import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session", autouse=True)
def _workers(spark):
    from basketry.llm.store import package_on_workers

    package_on_workers(spark)
