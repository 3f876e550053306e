"""Every query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest
from conftest import TABLES

import __spark_entry__ as entry

from quiverql import registry


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, data, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    frame = registry.FOUND[name](spark, data)
    columns = sorted(frame.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    asked = db.execute(registry.SQL[name])
    names = [d[0] for d in asked.description]
    assert sorted(names) == columns
    assert found == sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in asked.fetchall()), key=repr)


def test_entry(spark, data):
    assert entry.entry(spark).columns == ["nation", "buyers", "most"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def planned(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_variants_are_read_before_they_meet(spark, data):
    joins = [line for line in planned(registry.FOUND["mixed_equality"](spark, data)).split("\n") if "Join" in line]
    assert joins and not any("variant" in line.lower() for line in joins)


def test_rows_that_meet_all_others_are_dealt_out(spark, data):
    assert f"Repartition {4 * spark.sparkContext.defaultParallelism}, true" in planned(registry.FOUND["theta_filter"](spark, data))


def test_directions_count_before_the_second_join(spark, data):
    plan = planned(registry.FOUND["schema_directions"](spark, data))
    at = plan.index("Join Inner")
    assert plan.index("Join Inner", at + 1) > plan.index("Aggregate [source_type", at) > at


def test_stored_cycles_are_closed_by_both_ends(spark, data, monkeypatch):
    """No row meets all suppliers of its part, the edges that close are read by the ends that they meet at, and nothing is stored that the pattern doesn't ask for."""
    from quiverql.plans.compiler import Compiler
    from quiverql.sources import graph_json

    closed, loaded, plain, load = [], [], Compiler.close, graph_json.load_tables
    monkeypatch.setattr(Compiler, "close", lambda self, *a: closed.append(1) or plain(self, *a))
    monkeypatch.setattr(graph_json, "load_tables", lambda *a: loaded.append(load(*a)) or loaded[0])
    frame = registry.FOUND["stored_cycle"](spark, data)
    assert closed == [1]
    assert "edges_in" in next(line for line in frame._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line and "SUPPLIED_BY" in line)
    stored, whole = loaded[0], registry.commerce_graph(spark, data)
    assert stored.nodes.columns == ["id", "label", "type"] and set(stored.edges.columns) == {"id", "source", "target", "type"}
    for own, table in ((stored.nodes, whole.nodes), (stored.edges, whole.edges), (stored.by_target, whole.edges)):
        assert sorted(map(tuple, own.groupBy("type").count().collect())) == sorted(map(tuple, table.groupBy("type").count().collect()))
    # no two edges of one type stand in the pattern but these
    assert stored.edges.where("id is null").select("type").distinct().where("type = 'IN_NATION'").isEmpty()


def test_cycles_are_closed_by_both_ends(spark, data, graph, monkeypatch):
    from quiverql import GraphEngine
    from quiverql.plans.compiler import Compiler

    closed, plain = [], Compiler.close
    monkeypatch.setattr(Compiler, "close", lambda self, *a: closed.append(1) or plain(self, *a))
    registry.FOUND["rebind_cycle"](spark, data)
    assert closed == [1]
    asked = lambda text: sorted(tuple(r) for r in GraphEngine(graph).query(text).collect())
    assert asked("MATCH (a:Port)-[:ROUTE]->(b)-[:ROUTE]->(c)-[:ROUTE]->(a) RETURN a.id AS a, b.id AS b, c.label AS c") == [("cadiz", "oslo", "Kiel"), ("kiel", "cadiz", "Oslo"), ("oslo", "kiel", "Cádiz")]
    # an edge isn't used twice, also not one of the two that close
    assert asked("MATCH (a:Port)-[:ROUTE]-(b)-[:ROUTE]-(a) RETURN a.id AS a, b.id AS b") == []
    assert asked("MATCH (s:Ship)-[:CALLS]->(p:Port)-[:ROUTE]-(q:Port)<-[:CALLS]-(s) RETURN s.id AS s, p.id AS p, q.id AS q") == [("gull", "kiel", "oslo"), ("gull", "oslo", "kiel"), ("heron", "cadiz", "kiel"), ("heron", "kiel", "cadiz")]
