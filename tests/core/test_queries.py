"""Every query of the tile operators against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from cellweave.plans import geometry, layered, spatial  # noqa: F401
from cellweave.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return c


def plain(rows):
    fix = lambda v: int(v) if isinstance(v, float) and v == int(v) else round(v, 9) if isinstance(v, float) else v
    return sorted(repr([fix(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in SQL:
        told = duck.sql(SQL[name])
        columns = sorted(df.columns)
        assert columns == sorted(told.columns)
        assert plain([tuple(r[c] for c in columns) for r in rows]) == plain(told.select(*(f'"{c}"' for c in columns)).fetchall())


def test_plans_stay_in_the_jvm(spark):
    plan = QUERIES["normalized_difference"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan


def test_overview_has_cells_of_all_tiles(spark):
    sf = "/root/testdata/sf0.01"
    told = duckdb.sql(f"""select l_orderkey // 8 // 256 as block, count(distinct (l_orderkey, l_linenumber)) as n, sum(l_quantity) as s
        from '{sf}/lineitem.parquet' where (l_linenumber - 1) % 2 = 0 and l_orderkey % 2 = 1 group by 1""").fetchall()
    got = [(r.block, r.n, r.s) for r in QUERIES["overview"](spark, sf).collect()]
    assert len(got) > 1 and sorted(got) == sorted((b, n, float(s)) for b, n, s in told)
