from __future__ import annotations

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from drydock.functions.dictionary import (
    describe_columns,
    description_for,
    undocumented,
    update_dictionary,
)
from drydock.sources.catalog import columns

EXPECTED = {
    "id": "Unique identifier for this record.",
    "customer_id": "Reference to the associated customer.",
    "home_address_id": "Reference to the associated home address.",
    "status": "Current status of the record.",
    "order_status": "Current status of the record.",
    "substatus": None,
    "Amount": "Monetary value in the record's currency.",
    "total_count": "Monetary value in the record's currency.",
    "created_at": "Timestamp when the record was created.",
    "last_updated": "Timestamp of the most recent update to this record.",
    "deleted_on": "Soft-delete timestamp; NULL when the record is active.",
    "shipped_at": "Timestamp recording when shipped occurred.",
    "first_seen_time": "Timestamp recording when first seen occurred.",
    "order_type": "Categorical classification of the record.",
    "is_active": "Boolean flag.",
    "redflagged": "Boolean flag.",
    "tax_rate": "Ratio or percentage value.",
    "quantity": "Numeric count.",
    "count_items": "Numeric count.",
    "last_name": "Human-readable label or name.",
    "email_1": "Contact field: email 1.",
    "postal_code": "Geographic field: postal code.",
    "Mystery": "_What does `Mystery` represent? What values can it have?_",
}


@pytest.fixture(scope="module")
def described(spark):
    df = spark.createDataFrame([(n,) for n in EXPECTED], "name string")
    return {
        r["name"]: r["text"]
        for r in df.select("name", description_for(F.col("name")).alias("text")).collect()
    }


@pytest.mark.parametrize("name", EXPECTED)
def test_description(described, name):
    assert described[name] == (
        EXPECTED[name] or f"_What does `{name}` represent? What values can it have?_"
    )


def test_dictionary_of_a_catalog(spark, orders):
    tables = {"orders": orders, "part": spark.sql("SELECT 1 AS id, 2.0 AS unit_cost")}
    rows = describe_columns(columns(spark, tables)).collect()
    assert [tuple(r) for r in rows][3:] == [
        ("orders", "amount", "DOUBLE", "Monetary value in the record's currency."),
        ("part", "id", "INTEGER", "Unique identifier for this record."),
        ("part", "unit_cost", "DECIMAL(2,1)", "Monetary value in the record's currency."),
    ]


def test_upkeep(spark):
    schema = "table_name string, column_name string, data_type string"
    columns = spark.createDataFrame(
        [("a", "id", "BIGINT"), ("a", "region", "VARCHAR"), ("b", "id", "BIGINT")], schema
    )
    documented = spark.createDataFrame(
        [("a", "ID", "BIGINT", "By hand."), ("a", "dropped", "INT", "Gone.")],
        schema + ", description string",
    )
    new = undocumented(columns, documented)
    assert [r[:2] for r in rows_of(new)] == [("a", "region"), ("b", "id")]
    updated = update_dictionary(columns, documented)
    assert updated.count() == 4
    kept = {r["column_name"]: r["description"] for r in updated.where("table_name = 'a'").collect()}
    assert kept == {
        "ID": "By hand.", "dropped": "Gone.", "region": "Geographic field: region."
    }
    assert update_dictionary(columns, updated).count() == 4
