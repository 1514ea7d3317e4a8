import glob
import os

import duckdb
import pytest

from retrievium.plans import contract

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def norm(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(contract.QUERIES))
def test_equals_sql(spark, con, name):
    df = contract.QUERIES[name](spark, SF)
    sql = con.execute(contract.SQL[name])
    cols = sorted(df.columns)
    have = [d[0] for d in sql.description]
    assert sorted(have) == cols
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = sorted((tuple(norm(r[have.index(c)]) for c in cols) for r in sql.fetchall()), key=repr)
    assert got == want
    assert got or name in ("template_rotation",)


def test_every_query_has_sql():
    assert set(contract.QUERIES) == set(contract.SQL)


def test_gates_carry_no_texts_of_negatives(spark):
    """Documents are joined to queries and positives, before the negatives are listed; the report on their overlap alone needs their tokens."""
    scans = lambda name: contract.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("xxhash64")
    assert scans("quality_gate_summary") == scans("quality_gate_distribution") == 2 < scans("triplet_quality_report")
