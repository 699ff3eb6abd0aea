"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

from kgspark.plans import catalog
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


#: What SQL can't express; test_papers.py, test_graph_scale.py and test_passages.py hold it against plain loops.
WITHOUT_SQL = {"paper_dedup", "link_packs", "passage_matches"}


#: Those that find nothing in the smallest tables.
EMPTY = {"functional_gaps"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - WITHOUT_SQL))
def test_query_equals_sql(name, spark, duck):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted(repr([r[c] for c in columns]) for r in df.collect())
    result = duck.execute(catalog.ORACLE_SQL[name])
    there = [c[0] for c in result.description]
    assert sorted(there) == columns
    theirs = sorted(repr([row[there.index(c)] for c in columns]) for row in result.fetchall())
    assert mine == theirs
    assert mine or name in EMPTY


def test_every_query_has_sql():
    assert set(catalog.QUERIES) - WITHOUT_SQL == set(catalog.ORACLE_SQL)
