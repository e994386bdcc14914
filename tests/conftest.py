import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from heirloom.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark(
        "tests",
        "local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


LONG = (
    "Before the nightly export the operator drains the queue, checks that the last batch was "
    "acknowledged and only then rotates the signing key, because a key change mid-batch is refused."
)


def memory(id, content, memory_type="procedural", tags=(), agent="ada", salience=0.8):
    return (id, content, memory_type, list(tags), agent, float(salience))


@pytest.fixture
def memories(spark):
    def make(*rows, partitions=None):
        df = spark.createDataFrame(
            [(i, *r) for i, r in enumerate(rows)],
            "src_ord BIGINT, id STRING, content STRING, memory_type STRING, "
            "tags ARRAY<STRING>, agent_id STRING, salience FLOAT",
        )
        return df.repartition(partitions) if partitions else df

    return make
