import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


LOG = """2025-06-03 08:30:00 gate1 10.77.0.1 asked for /status
2025-06-03 08:31:00 gate1 198.51.100.8 sent 40 bytes
2025-06-03 08:32:00 gate2 2001:db8:7::2 asked for /map
2025-06-03 08:33:00 gate2 203.0.113.201 login failed, unknown name
2025-06-03 08:34:00 gate1 10.77.0.1 login accepted
2025-06-03 08:35:00 gate1 198.51.100.8 authentication failure
2025-06-03 08:36:00 gate3 172.20.3.4 opened the console
2025-06-03 08:37:00 gate3 192.168.50.5 sent 7 bytes
2025-06-03 08:38:00 gate3 10.77.0.250 went away
2025-06-03 08:39:00 gate2 203.0.113.201 login failed, relayed for 203.0.113.201
"""


@pytest.fixture
def lines(spark):
    """Makes lines of texts, in order."""
    from addrsift import from_lines

    def make(*texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, value string")
        return from_lines(rows, "value", "i")

    return make


@pytest.fixture
def log(lines):
    return lines(*LOG.splitlines())
