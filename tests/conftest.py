import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from meterstone.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
            "spark.sql.streaming.stateStore.providerClass": (
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
            ),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def write_log():
    """Write JSON lines; entries may be given as text to stay broken."""

    def write(path: Path, entries: list, end: str = "\n") -> Path:
        path.parent.mkdir(parents=True, exist_ok=True)
        lines = [e if isinstance(e, str) else json.dumps(e) for e in entries]
        path.write_text("\n".join(lines) + end)
        return path

    return write
