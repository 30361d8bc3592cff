"""Queries that SQL can express, against that SQL."""

import duckdb
import pytest

from tidemark.llm import oracle, queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = c.execute(oracle.oracle_sql()[name])
    at = [d[0] for d in rel.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(at) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*at).collect()), key=str) == sorted(rel.fetchall(), key=str)


def test_vector_sql(spark, tmp_path):
    """The table at hand has no link; on copies, links and unusable vectors the SQL says what brute force says."""
    import numpy as np

    from tidemark.llm import embedding_dedup

    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([*base, *(base[:12] + rng.normal(size=(12, 8)) * 0.1), *(base[:6] * 3)])]
    rows += [(100, None), (101, [0.0] * 8), (102, [float("nan")] * 8), (103, [None] * 8), (104, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/e")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    rel = c.execute(oracle.oracle_sql()["op4_embedding_dedup"])
    at = [d[0] for d in rel.description]
    want = rel.fetchall()
    assert sorted(map(tuple, embedding_dedup.dedup(df).select(*at).collect())) == sorted(want) and sum(r[at.index("n_links")] for r in want) > 20
