import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from lumenfold.engine import settings

    local = settings(SparkSession.builder.master("local[4]").appName("lumenfold-tests")).config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
    out = local.getOrCreate()
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()
