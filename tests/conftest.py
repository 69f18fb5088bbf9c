import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from spendlake.session import LOCAL_CONF

    b = SparkSession.builder.master("local[*]").appName("spendlake-tests").config("spark.sql.shuffle.partitions", "8")
    for k, v in LOCAL_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spendlake-test-ckpt-", dir="/tmp"))
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
