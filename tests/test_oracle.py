"""Every registered query of the library against its DuckDB oracle on sf0.01, rows,
names and types; no comparison of nothing with nothing."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_oracle import TABLES, rows_of, type_differences  # noqa: E402
from scriptorium.registry import SPARK, SQL  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, duck, name):
    df = SPARK[name](spark, SF)
    s_cols, s_rows = rows_of(df.columns, df.collect())
    cur = duck.execute(SQL[name])
    types = {c[0]: str(c[1]) for c in cur.description}
    d_cols, d_rows = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert s_cols == d_cols
    assert len(s_rows) > 0
    assert s_rows == d_rows
    assert type_differences(dict(df.dtypes), types) == {}


def test_assign_topics_invariants(spark):
    """One row per vector, probabilities sum to 1, the id is the most probable."""
    rows = SPARK["assign_topics"](spark, SF).collect()
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").distinct().count()
    assert len(rows) == len({r["vec_id"] for r in rows}) == vectors
    for r in rows:
        p = r["topic_distribution"]
        assert abs(sum(p) - 1) < 1e-6 and p[r["cluster_id"]] == max(p)
