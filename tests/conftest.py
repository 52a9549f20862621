import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("textgrove-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def _close(spark):
    yield
    from textgrove.workspace import close_workspaces

    close_workspaces()


@pytest.fixture(scope="session")
def embeddings(spark):
    return spark.read.parquet(f"{SMALL}/embeddings.parquet")


def weights_of(spark, vectors: dict):
    """``weights`` from {doc_id: [coordinates]}; zero coordinates are left out."""
    rows = [
        (doc, t, float(x)) for doc, vec in vectors.items() for t, x in enumerate(vec) if x != 0
    ]
    return spark.createDataFrame(rows, "doc_id long, term_id int, w double")
