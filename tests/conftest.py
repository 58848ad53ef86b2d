import datetime
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from codeloom import schema  # noqa: E402
from codeloom.operators.discovery import with_language  # noqa: E402

SMALL = "/root/testdata/sf0.001"
WHEN = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.codeloom.workload.partitions", "16")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files_of(spark):
    """A raw files table from {path: content}."""

    def make(contents, project="p"):
        rows = [
            (project, path, None if text is None else len(text.encode()), WHEN, text)
            for path, text in contents.items()
        ]
        return spark.createDataFrame(rows, schema.FILES)

    return make


@pytest.fixture(scope="session")
def typed_of(files_of):
    return lambda contents, project="p": with_language(files_of(contents, project))
