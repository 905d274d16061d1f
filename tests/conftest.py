import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cohortkit.session import get_spark

    s = get_spark("local[4]", 4, app_name="cohortkit-tests",
                  extra={"spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="ck-tests-"))
    yield s
