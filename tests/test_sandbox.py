from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime

import pytest
from conftest import final_plan, rows_of
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from drydock import workspace
from drydock.operators import transforms as T
from drydock.operators.guard import ProductionWriteBlocked
from drydock.plans.ledger import Ledger
from drydock.plans.sandbox import Sandbox, SandboxStore


@pytest.fixture
def store(spark, tmp_path):
    return SandboxStore(spark, root=str(tmp_path))


def test_clone_is_a_snapshot(spark, store, tmp_path, orders):
    path = str(tmp_path / "prod")
    orders.write.parquet(path)
    sandbox = store.create("analytics.orders", spark.read.parquet(path))
    orders.write.mode("append").parquet(path)
    assert store.read(sandbox.sandbox_name).count() == 5
    assert spark.read.parquet(path).count() == 10
    assert (sandbox.source_table, sandbox.n_rows, sandbox.version) == ("orders", 5, 0)
    assert sandbox.sandbox_name.startswith("sbx_orders_")
    assert sandbox.columns[0] == ("order_id", "bigint")


def test_two_clones_in_one_second_do_not_collide(store, orders):
    names = {store.create("orders", orders).sandbox_name for _ in range(2)}
    assert len(names) == 2
    assert {r["sandbox_name"] for r in store.current().collect()} == names


def test_many_writers_at_once(spark, store, orders):
    """Sandboxes made, changed and checked from several threads and two sessions are all recorded."""
    other = SandboxStore(spark.newSession(), root=store.root)
    ledger = Ledger(spark, store.root)

    def work(i):
        own = (store, other)[i % 2]
        sandbox = own.create("orders", own.spark.sql("SELECT id FROM range(5)") if own is other else orders)
        if i % 3 == 0:
            own.truncate(sandbox)
        run = dict(run_id=f"r{i}", sandbox_name=sandbox.sandbox_name, sandbox_version=0, source_table="orders",
                   check="c", definition="", status="PASS", result="", expected="", detail="",
                   run_at=datetime(2026, 1, 1), run_date=date(2026, 1, 1))
        ledger.append("quality_results", [run, run])
        return sandbox.sandbox_name

    with ThreadPoolExecutor(6) as pool:
        names = list(pool.map(work, range(18)))
    assert {r["sandbox_name"] for r in store.current().collect()} == set(names)
    assert ledger.read("sandboxes").count() == 18 + 6
    assert ledger.read("quality_results", "2026-01-01").count() == 36  # equal rows stay two
    assert os.listdir(f"{store.root}/ledger/_staged") == []


def test_folded_ledgers_read_the_same(spark, store, orders):
    sandbox = store.create("orders", orders)
    for i in range(4):
        sandbox = store.update(sandbox, {"amount": f"amount + {i}"})
    name, ledger = sandbox.sandbox_name, store.ledger
    before = rows_of(ledger.read("sandboxes", name))
    listed = ledger.read("sandboxes", name)  # a reader that has seen the files before they were folded
    assert ledger.fold("sandboxes", name) == 6
    assert rows_of(ledger.read("sandboxes", name)) == before == rows_of(listed)
    store.update(name, {"amount": "0"})
    assert ledger.fold("sandboxes", name) == 3  # the old fold, the late append, and the new fold
    assert ledger.fold("sandboxes", name, keep_sources=False) == 1
    assert store.get(name).version == 5
    assert len(before) + 1 == ledger.read("sandboxes", name).count() == ledger.read("sandboxes").count()
    assert ledger.fold("sandboxes", name) == 1
    assert ledger.fold("sandboxes", "sbx_unknown") == 0


def test_a_copy_that_cannot_be_recorded_is_removed(store, orders, monkeypatch):
    def refuse(*args, **kwargs):
        raise OSError("disk full")

    monkeypatch.setattr(store.ledger, "append", refuse)
    with pytest.raises(OSError, match="disk full"):
        store.create("orders", orders)
    assert os.listdir(f"{store.root}/sandboxes") == []


def test_types_survive(spark, store):
    df = spark.sql(
        "SELECT array(1.5f, 2.5f) AS v, timestamp_ntz'2024-01-02 03:04:05' AS t,"
        " CAST(1.25 AS decimal(18,2)) AS d, struct(1 AS a, 'x' AS b) AS s"
    )
    assert store.read(store.create("t", df)).schema.simpleString() == df.schema.simpleString()


def test_partition_folders_survive_changes(store, orders):
    sandbox = store.create("orders", orders, partition_by=["status"])
    changed = store.transform(
        sandbox, lambda df: T.update(df, {"amount": F.col("amount") + 1}), "UPDATE"
    )
    for version in (sandbox, changed):
        df = store.read(version).where("status = 'completed'")
        assert df.columns == orders.columns
        assert "PartitionFilters: [isnotnull(status" in final_plan(df)
        assert df.count() == 2


def test_versions_and_log(store, orders):
    sandbox = store.create("orders", orders)
    name = sandbox.sandbox_name
    store.update(name, {"amount": "amount * 2", "status": "upper(status)"})
    store.delete(name, "order_id = 1")
    store.add_column(name, "region", "string", "'EMEA'")
    store.transform(name, lambda df: df.where("order_id < 5"), "REPLACE")
    current = store.get(name)
    assert (current.version, current.n_rows) == (4, 3)
    assert store.read(name).agg(F.sum("amount")).first()[0] == pytest.approx(2 * 1270.49)
    log = store.transformations(name).orderBy("seq").collect()
    assert [(r["seq"], r["operation"], r["prod_statement"]) for r in log] == [
        (1, "UPDATE", "UPDATE analytics.orders SET amount = amount * 2, status = upper(status)"),
        (2, "DELETE", "DELETE FROM analytics.orders WHERE order_id = 1"),
        (3, "ALTER", "ALTER TABLE analytics.orders ADD COLUMN region string DEFAULT 'EMEA'"),
        (4, "REPLACE", None),
    ]
    assert store.read(sandbox).count() == 5  # an old version can still be read
    assert store.transformations().count() == 4


def test_statements_say_what_was_done(store, orders):
    """Replaying the logged expressions on production gives the sandbox."""
    sandbox = store.create("orders", orders)
    changed = store.update(sandbox, {"amount": "amount + 1"}, "status = 'completed'")
    statement = store.ledger.read("sandboxes", sandbox.sandbox_name).where("version = 1").first()["statement"]
    where = statement.split(" WHERE ")[1]
    value = statement.split("amount = ")[1].split(" WHERE ")[0]
    replayed = T.update(orders, {"amount": F.expr(value)}, where)
    assert rows_of(replayed) == rows_of(store.read(changed))


def test_vacuum_keeps_the_last_versions(store, orders):
    sandbox = store.create("orders", orders)
    folder = f"{store.root}/sandboxes/{sandbox.sandbox_name}"
    for _ in range(3):
        store.delete(sandbox.sandbox_name, "order_id = 1")
    assert store.vacuum(sandbox.sandbox_name, keep=2) == 2
    assert sorted(os.listdir(folder)) == ["v=2", "v=3"]
    assert store.vacuum(sandbox.sandbox_name) == 1
    assert store.read(sandbox.sandbox_name).count() == 4
    with pytest.raises(ValueError, match="must be kept"):
        store.vacuum(sandbox.sandbox_name, keep=0)


def test_second_commit_on_one_version_fails(store, orders):
    sandbox = store.create("orders", orders)
    store.commit(sandbox, orders.limit(1))
    folder = f"{store.root}/sandboxes/{sandbox.sandbox_name}"
    with pytest.raises(ValueError, match="moved on from version 0"):
        store.commit(sandbox, orders.limit(2))
    assert store.get(sandbox.sandbox_name).n_rows == 1
    assert len(os.listdir(f"{folder}/v=1")) == 1  # nothing was written


def test_of_two_commits_at_once_one_counts(store, orders, monkeypatch):
    sandbox = store.create("orders", orders)
    folder = f"{store.root}/sandboxes/{sandbox.sandbox_name}"
    record = store._record

    def after_another(new, **entry):
        monkeypatch.setattr(store, "_record", record)
        store.commit(sandbox, orders.limit(2))
        return record(new, **entry)

    monkeypatch.setattr(store, "_record", after_another)
    with pytest.raises(ValueError, match="moved on from version 0"):
        store.commit(sandbox, orders.limit(1))
    assert store.get(sandbox.sandbox_name).n_rows == 2
    assert len(os.listdir(f"{folder}/v=1")) == 1  # the refused one is gone
    assert [r["seq"] for r in store.transformations().collect()] == [1]


def test_a_failed_commit_can_be_repeated(store, orders):
    sandbox = store.create("orders", orders)
    broken = orders.withColumn("amount", F.raise_error(F.lit("boom")).cast("double"))
    with pytest.raises(PySparkException, match="boom"):
        store.commit(sandbox, broken)
    assert store.read(sandbox.sandbox_name).count() == 5
    assert store.commit(sandbox, orders.limit(2)).version == 1


def test_truncate_and_drop(store, orders):
    sandbox = store.create("orders", orders)
    empty = store.truncate(sandbox)
    assert store.read(empty).schema == store.read(sandbox).schema
    assert empty.n_rows == 0
    store.drop(empty)
    assert not os.path.exists(f"{store.root}/sandboxes/{sandbox.sandbox_name}")
    with pytest.raises(ValueError, match="no sandbox"):
        store.get(sandbox.sandbox_name)
    assert store.current().count() == 0


def test_unknown_sandbox(store):
    with pytest.raises(ValueError, match="no sandbox"):
        store.read("sbx_nothing")
    assert store.latest_for("orders") is None


def test_latest_for_table(store, orders):
    store.create("orders", orders)
    newest = store.create("orders", orders)
    store.create("customers", orders)
    store.commit(newest, orders.limit(1))
    assert store.latest_for("orders").sandbox_name == newest.sandbox_name
    assert store.latest_for("orders").version == 1


def test_only_sandboxes_are_written(spark, tmp_path, orders):
    store = SandboxStore(spark, root=str(tmp_path), prefix="")
    store.prefix = "sbx_"
    record = Sandbox(
        sandbox_name="orders", source_table="orders", created_at=None, version=0,
        path="x", partition_by=[], n_rows=0, columns=[],
    )
    for write in (
        lambda: store.commit(record, orders),
        lambda: store.truncate(record),
        lambda: store.drop(record),
    ):
        with pytest.raises(ProductionWriteBlocked):
            write()
    assert not os.path.exists(tmp_path / "sandboxes")


def test_workspace_outlives_checkpoints():
    settings = {"spark.checkpoint.dir": "hdfs://shared/work", "spark.sql.warehouse.dir": "hdfs://lake/"}

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: settings.get(key, default))

    assert workspace.workspace_root(Session) == "hdfs://lake//drydock"
    settings[workspace.ROOT_CONF] = "hdfs://tables/drydock/"
    assert workspace.workspace_root(Session) == "hdfs://tables/drydock"


def test_empty_ledger(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "none"))
    assert ledger.read("quality_results").count() == 0
    assert ledger.read("sandboxes", "sbx_x").count() == 0
