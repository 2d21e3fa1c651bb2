import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from odd_rows import ODD, SCHEMA, SF, rows_of, with_id  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    rows = rows_of(ODD)
    rows += [rows[5], with_id(rows[5], None), with_id(rows[7], None), (50, "x y z", None, None, None, *rows[0][5:])]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
