from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from drydock.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("workspace"))
    session = local_session(
        8, shuffle_partitions=4, app_name="tests",
        # The warehouse is a URI, as Spark's default is.
        **{"spark.drydock.workspace": folder, "spark.sql.warehouse.dir": f"file:{folder}/warehouse"},
    )
    yield session
    session.stop()


@pytest.fixture
def conf(spark):
    """Set Spark options for one test."""
    old = {}

    def set_options(**options):
        for name, value in options.items():
            key = "spark.sql." + name.replace("__", ".")
            old.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield set_options
    for key, value in old.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def orders(spark):
    """A small production table with NULLs nowhere."""
    rows = [
        (1, 10, "completed", 100.0),
        (2, 10, "completed", 250.5),
        (3, 20, "pending", 20.0),
        (4, 30, "shipped", 999.99),
        (5, 30, "cancelled", 5.0),
    ]
    return spark.createDataFrame(
        rows, "order_id bigint, customer_id bigint, status string, amount double"
    )


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def final_plan(df):
    """The executed plan's text, after running it, without the plans AQE gave up."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    kept, skip = [], None
    for line in text.splitlines():
        indent = len(line) - len(line.lstrip(" :"))
        if skip is not None and indent > skip:
            continue
        skip = None
        if "== Initial Plan ==" in line:
            skip = line.index("+- == Initial Plan ==")
            continue
        kept.append(line)
    return "\n".join(kept)
