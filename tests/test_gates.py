import pytest
from pyspark.sql import functions as F

from runledger.operators import gates


def test_non_empty_names_the_empty_table(spark, rows):
    full = spark.range(5)
    tables = {"full": full, "empty": full.where("id > 9"), "zero": full.limit(0)}
    got = rows(gates.non_empty(tables))
    assert got == [("non_empty", "empty", "no rows"), ("non_empty", "zero", "no rows")]
    assert gates.non_empty({"full": full}).isEmpty()


def test_non_empty_groups_names_keys_without_rows(spark, rows):
    expected = spark.createDataFrame([("a",), ("b",)], "k string")
    landed = spark.createDataFrame([("a", 1), ("a", 2), ("c", 3)], "k string, v int")
    assert rows(gates.non_empty_groups(expected, landed, "k")) == [("non_empty", "b", "no rows")]


def test_null_is_not_an_accepted_value(spark, rows):
    df = spark.createDataFrame(
        [("p", "api"), ("q", None), ("r", "ftp")], "name string, kind string"
    )
    assert rows(gates.accepted_values(df, "kind", ["api", "stream"], "name")) == [
        ("accepted_values", "q", "kind=NULL"),
        ("accepted_values", "r", "kind=ftp"),
    ]


@pytest.fixture
def vendors(spark):
    return spark.createDataFrame(
        [("p", "api"), ("q", "stream"), ("r", "file"), ("s", None)], "entity string, kind string"
    )


NEEDED = {"api": ["MOCK"], "stream": ["DB", "BROKER"]}


def test_required_keys_reports_each_missing_key_per_entity(spark, vendors, rows):
    pins = spark.createDataFrame([("DB",), ("DB",), ("OTHER",)], "key string")
    assert rows(gates.required_keys(vendors, NEEDED, pins)) == [
        ("required_keys", "p", "missing key MOCK"),
        ("required_keys", "q", "missing key BROKER"),
    ]


def test_required_keys_may_belong_to_the_entity(spark, vendors, rows):
    have = spark.createDataFrame([("q", "DB"), ("p", "BROKER")], "entity string, key string")
    assert rows(gates.required_keys(vendors, NEEDED, have)) == [
        ("required_keys", "p", "missing key MOCK"),
        ("required_keys", "q", "missing key BROKER"),
    ]


def test_contract_reports_every_broken_promise(spark, rows):
    df = spark.createDataFrame(
        [(1, "x", "O"), (1, "y", "F"), (2, None, "Q"), (None, "z", None), (None, "z", "O")],
        "id int, name string, status string",
    )
    contract = gates.Contract(
        "t",
        columns={"id": "bigint", "name": "string", "paid": "double"},
        not_null=("id", "name", "paid"),
        unique=("id",),
        accepted={"status": ["O", "F"]},
    )
    assert [r[1:] for r in rows(gates.contract_check(df, contract))] == [
        ("t.(id)", "repeated key: 2"),
        ("t.id", "null: 2"),
        ("t.id", "type int instead of bigint: 1"),
        ("t.name", "null: 1"),
        ("t.paid", "missing column: 1"),
        ("t.status", "value not accepted: 2"),
    ]
    empty = df.limit(0)
    assert [r[1] for r in rows(gates.contract_check(empty, contract))] == ["t.id", "t.paid"]


def test_contract_without_promises_is_refused(spark):
    with pytest.raises(ValueError):
        gates.contract_check(spark.range(1), gates.Contract("t", {}))


def test_contract_of_a_column_only_a_rule_names(spark, rows):
    contract = gates.Contract("t", {"id": "bigint"}, not_null=("gone",))
    assert rows(gates.contract_check(spark.range(3), contract)) == [
        ("contract", "t.gone", "missing column: 1")
    ]


def test_a_kept_contract_has_no_rows(spark):
    df = spark.range(100).withColumn("s", F.lit("O"))
    contract = gates.Contract("t", {"id": "bigint"}, ("id",), ("id",), {"s": ["O"]})
    assert gates.contract_check(df, contract).isEmpty()


def test_an_empty_requirement_needs_nothing(spark):
    entities = spark.createDataFrame([("a", "api")], "entity string, kind string")
    present = spark.createDataFrame([("k",)], "key string")
    assert gates.required_keys(entities, {}, present).isEmpty()
    assert gates.required_keys(entities, {"api": []}, present).isEmpty()


def test_a_key_with_a_missing_column_is_one_violation(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "a int, x int")
    found = gates.contract_check(df, gates.Contract("t", {}, unique=("a", "b"))).collect()
    assert [(r.entity, r.detail) for r in found] == [("t.b", "missing column: 1")]


def test_one_row_settles_a_table(spark):
    plan = gates.non_empty({"t": spark.range(100)})._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit 1" in plan
