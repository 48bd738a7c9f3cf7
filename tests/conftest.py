import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from ridegrid.session import configure

    session = (
        SparkSession.builder.master("local[4]")
        .appName("ridegrid-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.sparkContext.getCheckpointDir():  # tests set their own only when unset
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ridegrid-test-ckpt-"))
    configure(session)
    yield session


@pytest.fixture(scope="session")
def td(spark):
    from ridegrid.sources.testdata import TestData

    return TestData(spark, SF_SMALL)
