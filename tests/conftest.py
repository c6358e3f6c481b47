import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from gritlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("local[8]", "tests", **{
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "6g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def scan_text(spark):
    """Findings of one or more (path, content) pairs as a list of rows."""
    from gritlens.operators import security

    def run(*files, **options):
        frame = spark.createDataFrame(
            [("r", path, content) for path, content in files], "repo string, file_path string, content string"
        )
        return security.findings(frame, **options).collect()

    return run
