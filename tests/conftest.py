import datetime as dt
import os
import sys
import tempfile
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from emporion.schemas import TABLES  # noqa: E402
from emporion.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_PARITY = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "local[4]",
        app_name="emporion-tests",
        shuffle_partitions=8,
        extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="emporion-test-ckpt-")},
    )
    yield s
    s.stop()


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def table(spark, name: str, rows: list[dict]):
    """A fixture table in the registry's schema; unspecified columns are NULL."""
    meta = TABLES[name]
    schema = meta.spark_schema
    data = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
    return spark.createDataFrame(data, schema)


def money(x) -> Decimal:
    return Decimal(str(x))
