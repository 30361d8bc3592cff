"""Cleaning: each expression once in a plan, and issues of one kind alone."""

import duckdb
import pytest

from tidemark.functions import names as N
from tidemark.operators import cleaning as K
from tidemark.plans import catalogue
from tidemark.plans import cleaning as C

SF = "/root/testdata/sf0.001"


def size(frame):
    """How often an expression that cleaning uses everywhere stands in the optimised plan."""
    return frame._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace")


@pytest.mark.parametrize("name", ["issue_counts", "issue_unknown_state", "issue_invalid_phone"])
def test_issues_once(spark, name):
    once = size(K.clean(C.raw_records(spark, SF)).select("flags"))
    assert size(catalogue.queries()[name](spark, SF)) <= once


def test_resolvable_filter(spark):
    cleaned = K.clean(C.raw_records(spark, SF))
    assert size(cleaned.where("is_resolvable").select("record_id")) <= size(cleaned.select("flags"))


def test_issues_of(spark):
    raw = spark.createDataFrame([("a", None, None, None, None), ("b", "", "heading", "12", "x"), ("c", "Total", None, "Kota", "Haryana"), ("d", "Star Hospital", "", " ", "Atlantis")],
                                "record_id string, original_name string, text_role string, original_city string, original_state string")
    every = sorted(map(tuple, K.issues(K.clean(raw)).collect()))
    assert every and sorted(map(tuple, K.issues_of(raw, *K.ISSUES).collect())) == every
    for kind in ("missing_name", "unknown_state"):
        assert sorted(map(tuple, K.issues_of(raw, kind).collect())) == [x for x in every if x[1] == kind]
    cleaned = K.clean(raw).select("record_id", "is_resolvable", "name_normalized", "flags").collect()
    wrong = {r["record_id"] for r in cleaned if any(f["severity"] == "error" and f["field"] == "name" for f in r["flags"])}
    assert {r["record_id"] for r in cleaned if r["is_resolvable"]} == {r["record_id"] for r in cleaned if r["name_normalized"]} - wrong == {"d"}


def test_repeated_phrases_and_parts(spark):
    names = ["M/s. A.B. Hosp", "Co operative  S M S", "​Ｓtar (P) Ltd", "p. ltd", "N/A", None, " x ", "Dr. A . B ć"]
    got = spark.createDataFrame([(n,) for n in names], "original_name string").select(N.name_forms("original_name")["normalized"].alias("n"), "original_name").withColumn("record_id", N.F.lit("r"))
    assert [r["n"] for r in got.collect()] == [r["name_normalized"] for r in K.clean(got).select("name_normalized").collect()]


#: Raw columns that a query squeezes; a name is squeezed again behind its phrases, and identifiers are by their parts.
SQUEEZED = {
    "issue_counts": 11,
    "issue_city_name_conflict": 3,
    "issue_invalid_phone": 1,
    "issue_unknown_state": 1,
    "issue_invalid_email": 1,
    "issue_missing_name": 1,
    "issue_placeholder_phone": 1,
    "issue_not_an_entity_line": 1,
    "issue_invalid_name": 1,
    "issue_invalid_registration_id": 3,
    "issue_suspicious_name": 1,
    "issue_invalid_pincode": 1,
    "issue_invalid_website": 1,
    "issue_pincode_state_mismatch": 2,
    "issue_city_state_mismatch": 2,
    "issue_invalid_city": 1,
}


@pytest.mark.parametrize("name", SQUEEZED)
def test_issue_reads_once(spark, name, tmp_path):
    duckdb.sql(f"COPY (SELECT * FROM '{SF}/customer.parquet' UNION ALL SELECT * FROM '{SF}/customer.parquet') TO '{tmp_path}/customer.parquet'")
    frame = catalogue.queries()[name](spark, str(tmp_path))
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("translate(") <= SQUEEZED[name]
    customer = duckdb.read_parquet(f"{tmp_path}/customer.parquet")  # noqa: F841, read by the SQL
    assert sorted(map(tuple, frame.collect())) == sorted(duckdb.sql(catalogue.oracle_sql()[name]).fetchall())


@pytest.mark.parametrize("name", [n for n in SQUEEZED if n.startswith("issue_") and n not in ("issue_counts", "issue_city_name_conflict")])
def test_dealt_without_sort(spark, name):
    """Records are dealt to as many tasks as before, by their key: dealing in turn sorts all of them in the few tasks that read."""
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(c_custkey" in plan and "RoundRobin" not in plan
    assert catalogue.queries()[name](spark, SF).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
