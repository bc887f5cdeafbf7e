import duckdb
import pytest

import __spark_entry__ as entry
from linkwright import catalog

SF = "/root/testdata/sf0.001"
NORMAL = {True: "true", False: "false"}


def text(v):
    return NORMAL.get(v, str(v)) if isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_as_sql(spark, sql, name):
    got = catalog.queries()[name](spark, SF)
    want = sql.sql(catalog.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = sorted(tuple(text(r[c]) for c in cols) for r in got.collect())
    assert rows == sorted(tuple(text(v) for v in r) for r in want.select(*[f'"{c}"' for c in cols]).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_clusters_are_within_components_and_cover_all_records(spark):
    q = catalog.queries()
    component = {r.rec: r.component for r in q["components_with_dups"](spark, SF).collect()}
    for name in ("star_clusters", "clique_clusters", "agglomerative", "hac", "source_consistent", "knn_complete"):
        rows = {r.rec: r.cluster for r in q[name](spark, SF).collect()}
        assert rows.keys() == component.keys()
        assert all(component[r] == component[c] for r, c in rows.items())


def test_entry(spark):
    assert entry.entry(spark).columns == ["size", "clusters"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
