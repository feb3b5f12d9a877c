"""Every registered query against its SQL, and the row counts known beforehand."""

import pytest

import __spark_entry__
from runledger.plans.oracle import ORACLE as SQL
from runledger.plans.registry import QUERIES
import oracle
from conftest import TESTDATA



@pytest.fixture(scope="module")
def small():
    return oracle.connect(f"{TESTDATA}/sf0.001")


def test_every_query_has_sql_and_is_registered():
    assert set(QUERIES) == set(SQL)
    assert QUERIES.items() <= __spark_entry__.queries().items()
    assert SQL.items() <= __spark_entry__.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, small, name):
    problems, n_rows = oracle.compare(QUERIES[name](spark, f"{TESTDATA}/sf0.001"), small, SQL[name])
    assert not problems
    if name not in ("term_scan_token",):
        assert n_rows > 0


def test_entry_returns_the_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["dag_id", "run_id", "task_id", "attempt_id", "line_no", "line"]
    assert df.count() == 245


@pytest.mark.parametrize(
    "name, n_rows",
    [
        ("unfinished_tasks", 595 + 1769),
        ("failed_tasks", 595),
        ("newest_attempt", 2921),
        ("log_tail", 2796),
        ("failure_report", 675),
        ("term_scan", 13),
        ("term_scan_token", 10),
        ("cdc_apply", 120),
        ("silver_dedup", 45832),
        ("parity_check_raw", 14168),
    ],
)
def test_row_counts_at_the_next_scale(spark, name, n_rows):
    df = QUERIES[name](spark, f"{TESTDATA}/sf0.01")
    if name == "parity_check_raw":
        assert df.groupBy().sum("copies").first()[0] == n_rows
    else:
        assert df.count() == n_rows


@pytest.mark.parametrize(
    "name, column, expected",
    [
        (
            "run_decision",
            "decision",
            {"absent": 30, "adopt": 388, "parse_error": 30, "refuse_busy": 420,
             "refuse_paused": 360, "trigger": 272},
        ),
        (
            "run_verdict",
            "verdict",
            {"failed": 5088, "no_verdict": 965, "pending": 1026, "success": 7921},
        ),
        ("single_owner", "status", {"resolved": 518, "ambiguous": 764 + 218}),
    ],
)
def test_split_by_outcome_at_the_next_scale(spark, name, column, expected):
    df = QUERIES[name](spark, f"{TESTDATA}/sf0.01")
    assert {r[column]: r["count"] for r in df.groupBy(column).count().collect()} == expected
