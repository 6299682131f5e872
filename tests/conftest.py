import os
import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    found = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.sql.warehouse.dir", f"{tempfile.gettempdir()}/pagelens-warehouse-{os.getpid()}").getOrCreate()
    found.sparkContext.setLogLevel("ERROR")
    return found
