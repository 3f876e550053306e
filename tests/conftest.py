import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    where = Path("/root/testdata/sf0.001")
    if not where.exists():
        pytest.skip("the test tables are not here")
    return str(where)


@pytest.fixture(scope="session")
def graph(spark):
    """Ports on a round trip, ships that call there and what they load; one ship has itself in tow. What isn't known is left out."""
    nodes = [
        ("oslo", "Oslo", "Port", {"depth": 12, "note": "Deep and cold", "open": True}), ("kiel", "Kiel", "Port", {"depth": 9, "open": False}), ("cadiz", "Cádiz", "Port", {"note": "Warm water"}),
        ("gull", "Gull", "Ship", {"knots": 18, "note": "Refit 1998", "open": True}), ("heron", "Heron", "Ship", {"knots": 22}), ("tern", "Tern", "Ship", {"knots": 18}),
        ("salt", "Salt", "Cargo", {"tons": 40}), ("tin", "Tin", "Cargo", {"tons": 15}), ("cork", "cork", "Cargo", {}),
    ]
    edges = [
        ("r1", "oslo", "kiel", "ROUTE", {"days": 2, "stops": ["Aarhus"]}), ("r2", "kiel", "cadiz", "ROUTE", {"days": 6}), ("r3", "cadiz", "oslo", "ROUTE", {"days": 7}),
        ("c1", "gull", "oslo", "CALLS", {"days": 1}), ("c2", "gull", "kiel", "CALLS", {}), ("c3", "heron", "kiel", "CALLS", {"days": 3}), ("c4", "heron", "cadiz", "CALLS", {}),
        ("l1", "gull", "salt", "LOADS", {}), ("l2", "heron", "salt", "LOADS", {}), ("l3", "heron", "tin", "LOADS", {}), ("t1", "tern", "tern", "TOWS", {}),
    ]
    return make_graph(spark, nodes, edges)


NODE = "depth bigint, knots bigint, tons bigint, note string, open boolean"
EDGE = "days bigint, stops array<string>"


def make_graph(spark, nodes, edges, node=NODE, edge=EDGE):
    from quiverql import PropertyGraph

    own, link = ([c.split()[0] for c in x.split(", ")] for x in (node, edge))
    as_struct = lambda x: ", ".join(": ".join(c.split()) for c in x.split(", "))
    n = [(i, label, t, k, tuple(p.get(x) for x in own)) for k, (i, label, t, p) in enumerate(nodes)]
    e = [(i, s, t, kind, k, tuple(p.get(x) for x in link)) for k, (i, s, t, kind, p) in enumerate(edges)]
    return PropertyGraph(
        spark.createDataFrame(n, f"id string, label string, type string, ord bigint, properties struct<{as_struct(node)}>").coalesce(1).cache(),
        spark.createDataFrame(e, f"id string, source string, target string, type string, ord bigint, properties struct<{as_struct(edge)}>").coalesce(1).cache(),
    )
