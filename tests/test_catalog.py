from __future__ import annotations

import uuid

import pytest
from conftest import final_plan, rows_of
from pyspark.sql import functions as F

from drydock.operators.guard import ProductionWriteBlocked
from drydock.sources import catalog as C
from drydock.sources.delimited import ingest_csv, read_delimited
from drydock.sources.rows import load_demo, values


@pytest.fixture
def catalog(spark, tmp_path):
    name = f"db_{uuid.uuid4().hex[:8]}"
    yield C.Catalog(spark, name, root=str(tmp_path))
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def types(df):
    return [f.dataType.simpleString() for f in df.schema]


def test_listing_hides_sandboxes_and_audit(spark):
    tables = {n: spark.range(3) for n in ("b", "a", "sbx_a_1", "SBX_b", "QG_quality_results")}
    assert rows_of(C.list_tables(tables)) == [("a", 3, "id (BIGINT)"), ("b", 3, "id (BIGINT)")]


def test_parquet_tables_are_counted_by_one_scan(spark, tmp_path):
    tables, want = {}, {}
    for i in range(40):
        path = str(tmp_path / f"t {i}" / "data")
        spark.range(i).repartition(2).write.partitionBy(*(["id"] if i == 3 else [])).mode("overwrite").parquet(
            path
        ) if i != 3 else spark.range(3).withColumn("x", F.lit(1)).write.partitionBy("id").parquet(path)
        tables[f"t{i}"], want[f"t{i}"] = spark.read.parquet(path) if i else spark.read.schema("id long").parquet(path), i
    tables |= {"again": tables["t7"], "above": spark.read.schema("id long").parquet(str(tmp_path / "t 9")),
               "filtered": tables["t9"].where("id > 5"), "made": spark.range(6), "aliased": tables["t8"].alias("a")}
    single = next((tmp_path / "t 30" / "data").glob("*.parquet"))
    tables["file"] = spark.read.parquet(f"file://{single}")
    want |= {"again": 7, "above": 9, "filtered": 3, "made": 6, "aliased": 8, "file": spark.read.parquet(str(single)).count()}
    counts = C.row_counts(tables)
    assert {r["table_name"]: r["row_count"] for r in counts.collect()} == want
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2  # the one scan, and the filtered table
    assert "ReadSchema: struct<>" in final_plan(C.row_counts({n: tables[n] for n in ("t5", "t6")}))


def test_describe(spark):
    df = spark.sql("SELECT 1 AS a, 'x' AS b, array(1.5f) AS v, timestamp_ntz'2024-01-01' AS t")
    rows = [tuple(r) for r in C.describe_table("d", df).collect()]
    assert rows == [
        ("a", "INTEGER", False, 1, 1), ("b", "VARCHAR", False, 2, 1),
        ("v", "FLOAT[]", False, 3, 1), ("t", "TIMESTAMP", False, 4, 1),
    ]


def test_create_only(spark, catalog):
    assert not catalog.exists("t")
    catalog.create("t", spark.range(3))
    assert catalog.exists("t")
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        catalog.create("t", spark.range(4))
    assert catalog.table("t").count() == 3
    with pytest.raises(ValueError, match="table .* is not a plain name"):
        catalog.exists("t; DROP TABLE t")


def test_tables_without_views(spark, catalog):
    catalog.create("t", spark.range(3))
    spark.sql(f"CREATE VIEW {catalog.schema}.v AS SELECT * FROM {catalog.schema}.t")
    spark.range(1).createOrReplaceTempView("temporary")
    assert list(catalog.tables()) == ["t"]


def test_demo_tables_load_repeatedly(catalog):
    for _ in range(2):
        demo = load_demo(catalog)
    assert {name: df.count() for name, df in demo.items()} == {"customers": 10, "orders": 50}
    orders = demo["orders"]
    assert orders.select("order_id").distinct().count() == 50
    assert orders.join(demo["customers"], "customer_id", "left_anti").count() == 0
    assert orders.select("status").distinct().count() == 4
    assert orders.dropna().count() == 50
    assert types(orders) == ["bigint", "bigint", "double", "string", "timestamp_ntz"]


def test_loaders_drop_only_what_they_made(spark, catalog):
    catalog.create("customers", spark.range(7))
    with pytest.raises(ProductionWriteBlocked, match="is kept"):
        load_demo(catalog)
    assert catalog.table("customers").count() == 7


def test_values(spark):
    df = values(spark, [(1, "a"), (2, None)], "id bigint, name string")
    assert rows_of(df) == [(1, "a"), (2, None)]


def test_ingest_infers_types_from_all_values(spark, catalog, tmp_path):
    rows = [
        "id,code,price,day,at,flag,mixed,empty,big,name",
        "1,007,1.5,2024-01-02,2024-01-02 03:04:05,true,1,,1,a",
        '2,010,2,2024-01-03,2024-01-02T03:04:05.123,FALSE,x,,99999999999,"b, ""c"""',
        "3,100,.5,,2024-01-04,,2,,3,",
    ]
    df = ingest_csv(catalog, "t", write(tmp_path, "t.csv", "\n".join(rows) + "\n"))
    assert types(df) == [
        "bigint", "string", "double", "date", "timestamp_ntz", "boolean", "string", "string",
        "bigint", "string",
    ]
    assert [r["code"] for r in df.orderBy("id").collect()] == ["007", "010", "100"]
    assert df.where("id = 2").first()["name"] == 'b, "c"'
    with pytest.raises(ValueError, match="already exists"):
        ingest_csv(catalog, "t", str(tmp_path / "t.csv"))


@pytest.mark.parametrize("sep", ["\t", "|", ";"])
def test_separators(spark, tmp_path, sep):
    path = write(tmp_path, "t.tsv", f"a{sep}b\n1{sep}x,y\n")
    assert rows_of(read_delimited(spark, path)) == [(1, "x,y")]


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = write(tmp_path, "t.csv", 'id,note,n\n1,"two\nlines",5\n2,one,6\n')
    with pytest.raises(ValueError, match="ask for multiline"):
        read_delimited(spark, path)
    assert rows_of(read_delimited(spark, path, multiline=True)) == [(1, "two\nlines", 5), (2, "one", 6)]
    last = write(tmp_path, "last.csv", 'id,note\n1,"two\nlines"\n2,one\n')
    assert rows_of(read_delimited(spark, last, multiline=True)) == [(1, "two\nlines"), (2, "one")]
    single = write(tmp_path, "single.csv", 'note\n"two\nlines"\none\n')
    assert rows_of(read_delimited(spark, single, multiline=True)) == [("one",), ("two\nlines",)]


def test_whole_numbers_beyond_bigint(spark, tmp_path):
    path = write(tmp_path, "big.csv", "id,n\n12345678901234567890,1\n12345678901234567891,2.5\n")
    df = read_delimited(spark, path)
    assert types(df) == ["decimal(38,0)", "double"]
    assert sorted(int(r["id"]) for r in df.collect()) == [12345678901234567890, 12345678901234567891]
    path = write(tmp_path, "mixed.csv", "id,n\n12345678901234567890,1\n1.5,2\n")
    assert types(read_delimited(spark, path)) == ["string", "bigint"]


def test_one_column_is_split_into_tasks(spark, tmp_path, conf):
    path = str(tmp_path / "one")
    spark.range(200000).coalesce(1).write.csv(path, header=True)
    conf(files__maxPartitionBytes="200k", files__openCostInBytes="1k")
    df = read_delimited(spark, path)
    assert (types(df), df.count()) == (["bigint"], 200000)
    assert df.rdd.getNumPartitions() > 3


def test_malformed_input_is_an_error(spark, tmp_path):
    path = write(tmp_path, "t.csv", "a,b\n1,2\n3\n")
    with pytest.raises(ValueError, match="do not fit"):
        read_delimited(spark, path)
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE"):
        read_delimited(spark, path, schema="a int, b int").collect()


def test_explicit_schema(spark, tmp_path):
    path = write(tmp_path, "t.csv", "a,b\n1,2\n")
    assert types(read_delimited(spark, path, schema="a string, b double")) == ["string", "double"]


@pytest.mark.parametrize("source", ["relative.csv", "/a'b.csv", "/a;b.csv", "a b.csv", "/a<b", "nofs://x/a.csv", ""])
def test_unsafe_sources(catalog, source):
    with pytest.raises(ValueError, match="absolute path"):
        ingest_csv(catalog, "t", source)


def test_sources_are_uris_of_any_form(spark, catalog, tmp_path):
    folder = tmp_path / "with blank"
    folder.mkdir()
    path = write(folder, "a b,c.csv", "id,x\n1,a\n2,b\n")
    for i, source in enumerate([path, f"file:{path}", f"file://{path}", f" {path} ", str(folder), f"{folder}/*.csv"]):
        assert ingest_csv(catalog, f"t{i}", source).count() == 2
    with pytest.raises(ValueError, match="does not exist"):
        ingest_csv(catalog, "none", f"file:{tmp_path}/no such.csv")
    with pytest.raises(ValueError, match="already exists"):
        ingest_csv(catalog, "t0", f"file://{path}")


def test_kinds_of_single_values(spark, tmp_path):
    """Each column holds one value twice, and gets the narrowest type that reads it as it is."""
    wanted = {
        "5": "bigint", "-5": "bigint", "+5": "bigint", "0": "bigint", "-0": "bigint", "05": "string", "5-": "string",
        "9223372036854775808": "decimal(38,0)", "1" * 39: "string", "1.5": "double", "-.5": "double", "1.": "double",
        "1e5": "double", "01.5": "string", "true": "boolean", "FALSE": "boolean", "tru": "string", "t": "string",
        "2024-02-29": "date", "2023-02-29": "string", "2024-1-1": "string", "2024-01-01 10:00": "timestamp_ntz",
        "2024-01-01T10:00:00.5": "timestamp_ntz", "2024-01-01 25:00": "string", "1234-5": "string", "NaN": "string",
        "-": "string", "Infinity": "string", "é": "string",
    }
    line = ",".join(wanted)
    path = write(tmp_path, "t.csv", ",".join(f"c{i}" for i in range(len(wanted))) + f"\n{line}\n{line}\n")
    assert dict(zip(wanted, types(read_delimited(spark, path)))) == wanted


def test_folder_of_files(spark, tmp_path):
    path = str(tmp_path / "csv")
    spark.range(100).withColumn("x", F.col("id") / 4).repartition(5).write.csv(path, header=True)
    df = read_delimited(spark, path)
    assert (types(df), df.count()) == (["bigint", "double"], 100)
