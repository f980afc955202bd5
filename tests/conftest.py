import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from corpusloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="4g", spark__sql__codegen__wholeStage="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate a column expression over a list of texts (column `x`)."""

    def run(expression, texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
        return [r[1] for r in rows.select("i", expression.alias("v")).orderBy("i").collect()]

    return run
