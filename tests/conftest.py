import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    built = session(
        "local[8]",
        app="tests",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    built.sparkContext.setLogLevel("ERROR")
    if not built.conf.get("spark.checkpoint.dir", None):
        built.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    yield built
    built.stop()


FEED = "seq bigint, cluster_time timestamp, operation_type string, document_key string, full_document string"


@pytest.fixture
def make_feed(spark):
    """Feed rows from (seq, operation, key, document) with one second between events."""
    from datetime import datetime, timedelta, timezone

    start = datetime(2026, 8, 24, 19, 0, tzinfo=timezone.utc)

    def make(*events):
        rows = [(seq, start + timedelta(seconds=seq), op, key, doc) for seq, op, key, doc in events]
        return spark.createDataFrame(rows, FEED)

    return make
