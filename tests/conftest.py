from datetime import datetime, timedelta

import pytest

from opslog.schema import LOGS
from opslog.session import build_session

START = datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_logs(spark):
    """Logs from (message, template_id) pairs, one per second unless a time is given."""
    def make(rows):
        out = []
        for i, row in enumerate(rows):
            message, template = row[0], row[1]
            at = START + timedelta(seconds=row[2] if len(row) > 2 else i)
            out.append((i, at, "app-01", "INFO", message, template, None))
        return spark.createDataFrame(out, LOGS)

    return make
