"""Every query with SQL against DuckDB at the smallest size; the others run."""

import math

import duckdb
import pytest

import chainweave.plans.further_queries  # noqa: F401
import chainweave.plans.inference_queries  # noqa: F401
import chainweave.plans.joint_queries  # noqa: F401
import chainweave.plans.queries  # noqa: F401
import chainweave.plans.span_queries  # noqa: F401
import chainweave.plans.token_queries  # noqa: F401
from chainweave.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return repr(float(v)) if isinstance(v, float) or type(v).__name__ == "Decimal" else "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(columns).collect())
    if name not in SQL:
        assert rows
        return
    relation = duck.sql(SQL[name])
    assert sorted(relation.columns) == columns
    shown = ", ".join(f'"{c}"' for c in columns)
    assert sorted(tuple(map(plain, r)) for r in duck.sql(f"select {shown} from ({SQL[name]})").fetchall()) == rows
