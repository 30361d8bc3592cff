"""Every registered query against its SQL, and scalar cases."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import records as R
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    names = sorted(got.columns)
    rel = duck.execute(catalogue.oracle_sql()[name])
    at = [d[0] for d in rel.description]
    assert sorted(at) == names
    want = sorted(([plain(r[at.index(n)]) for n in names] for r in rel.fetchall()), key=str)
    have = sorted(([plain(r[n]) for n in names] for r in got.collect()), key=str)
    assert have == want and have


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_similarity(spark):
    pairs = [("sms hospital", "sms hosptal"), ("", "a"), ("", ""), ("abc", "abc"), ("kitten", "sitting"), ("ab", "ba")]
    got = spark.createDataFrame(pairs, "a string, b string").select(T.ratio(F.col("a"), F.col("b"))).collect()
    for (a, b), r in zip(pairs, got):
        assert abs(r[0] - (200 * lcs(a, b) / (len(a) + len(b)) if a + b else 100)) < 1e-9


def test_token_set_ratio(spark):
    pairs = [("a b", ""), ("city hospital", "hospital city kota"), ("alpha beta", "alpha gamma"), ("ab cd", "xy")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(T.token_set_ratio(F.col("a"), F.col("b"))).collect()]
    r = lambda a, b: 200 * lcs(a, b) / (len(a) + len(b))
    want = [0, 100, max(r("alpha", "alpha beta"), r("alpha", "alpha gamma"), r("alpha beta", "alpha gamma")), r("ab cd", "xy")]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))


def test_scalars(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c(F.col("v"))).first()[0]
    assert one(T.price, "₹1,250.50") == 1250.5 and one(T.price, "100-200") is None and one(T.price, "on request") is None and one(T.price, "0") == 0
    assert one(T.phones, "0141-2560101 / 9876500011") == ["1412560101", "9876500011"] and one(T.phones, "9876500011.0") == ["9876500011"]
    assert one(T.phones, "98765") == [] and one(T.phones, "9999999999") == [] and one(T.phones, None) == []
    assert one(T.pincode, "302 004") == "302004" and one(T.normal, " St. Mary's & Co ") == "st marys and co" and one(T.strip_null_like, " N/A") == ""
    assert one(lambda c: T.guard_formula(c, "export"), "=1") == "'=1" and one(lambda c: T.guard_formula(c, "export"), "+1") == "+1" and one(T.guard_formula, "+1") == "'+1"
    assert one(T.acronym, "Sawai Man Singh") == "sms" and one(T.natural_key, "a10") > one(T.natural_key, "a9") and one(T.natural_key, "1" * 22) != one(T.natural_key, "1" * 21 + "2")
    bands = spark.createDataFrame([(99,), (90,), (75,), (55,), (10,)], "s int").select(R.band(F.col("s"))).collect()
    assert [r[0] for r in bands] == ["Very High", "High", "Possible Match", "Manual Review", "Probably Different"]


def test_upsert(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, R.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_names(spark):
    assert catalogue.queries()["name_links"](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
