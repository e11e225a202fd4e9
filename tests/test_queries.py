"""Registered queries against DuckDB on the smallest tables."""

import duckdb
import pytest

from graphloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def same(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows)


@pytest.mark.parametrize("name", ["node", "edge", "connected_component", "neighborhood", "path", "clique", "merge", "intersection_edges", "filter_node_label", "scalars", "vectorize_graph", "select_top", "pareto_front"])
def test_same_as_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    found = duck.execute(catalog.ORACLE[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert same([tuple(r) for r in df.collect()], df.columns) == same(found.fetchall(), names)


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)


def test_generators(spark):
    from graphloom.functions.analysis import label_counts
    from graphloom.sources.generators import SHAPES, labelled_graphs, random_graphs

    for shape in SHAPES:
        ag = random_graphs(spark, 2, shape, instance_size=8)
        assert ag.base.count() == 2 and label_counts(ag).agg({"n": "sum"}).first()[0] == 16
    assert sorted(r.target for r in labelled_graphs(spark, 2).base.select("target").collect()) == [0, 0, 1, 1]
