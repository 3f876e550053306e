import json
import random
import time

import pytest
from conftest import make_graph

from quiverql import GraphEngine, QueryError, QueryLimitError, QueryLimits

GOLDEN = [
    ("MATCH (s:Ship) RETURN s.label, s.knots * 2 AS twice, s.properties.knots - 1 AS less ORDER BY s.knots DESC, s.label", [["Heron", 44, 21], ["Gull", 36, 17], ["Tern", 36, 17]]),
    ("MATCH (a:Port)-[r:ROUTE]-(b:Port {id: 'kiel'}) RETURN a.id, r.days ORDER BY r.days", [["oslo", 2], ["cadiz", 6]]),
    ("MATCH (s:Ship)-[:CALLS]->(p), (s)-[:LOADS]->(c:Cargo) WHERE c.tons >= 40 RETURN s.id AS s, p.id AS p ORDER BY s, p", [["gull", "kiel"], ["gull", "oslo"], ["heron", "cadiz"], ["heron", "kiel"]]),
    ("MATCH way = (a:Port {id: 'oslo'})-[legs:ROUTE*1..3]->(b) RETURN b.id, length(way), size(legs) ORDER BY size(legs)", [["kiel", 1, 1], ["cadiz", 2, 2], ["oslo", 3, 3]]),
    ("MATCH way = (c:Cargo)-[x:LOADS*0..1]-(y) WHERE c.id = 'tin' RETURN y.id, length(way), size(nodes(way)), size(x) ORDER BY length(way)", [["tin", 0, 1, 0], ["heron", 1, 2, 1]]),
    ("MATCH (a:Ship)-[:CALLS|ROUTE*2]->(b:Port) RETURN a.id, b.id ORDER BY a.id, b.id", [["gull", "cadiz"], ["gull", "kiel"], ["heron", "cadiz"], ["heron", "oslo"]]),
    ("MATCH (c:Cargo) OPTIONAL MATCH (s:Ship)-[:LOADS]->(c) RETURN c.label, count(s) AS n, collect(s.label) AS who ORDER BY n DESC", [["Salt", 2, ["Gull", "Heron"]], ["Tin", 1, ["Heron"]], ["cork", 0, []]]),
    ("MATCH (p:Port)<-[:CALLS]-(s) WITH p, count(*) AS n, max(s.knots) AS top WHERE n >= 1 RETURN p.id, n, top ORDER BY n DESC, p.id SKIP 1 LIMIT 1", [["cadiz", 1, 22]]),
    ("MATCH (p:Port) RETURN count(p.depth), sum(p.depth), avg(p.depth), min(p.note), max(p.label), count(DISTINCT p.open)", [[2, 21, 10.5, "Deep and cold", "Oslo", 2]]),
    ("MATCH (p:Lighthouse) RETURN avg(p.depth), count(p), collect(DISTINCT p.id), sum(1), max(p.label)", [[None, 0, [], 0, None]]),
    ("MATCH (p:Lighthouse) RETURN p.type, max(p.depth)", []),
    ("RETURN NULL OR FALSE, TRUE AND NULL, NOT (NULL = 3), 2 IN [], NULL IN [1], 2 <> NULL, FALSE = 0, {k: [1.0]} = {k: [1]}, [0] = ['0']", [[None, None, None, False, None, None, False, True, False]]),
    ("RETURN [4, 5, 6][0], [4, 5, 6][-3], {a: {b: 'deep'}}.a.b, 'tab\\there', -9 % 4, 9 % -4, 9 / 4, 2 * 3 - 4, 'hull'[1], size('Cádiz'), [[], [7]][1][0]", [[4, 4, "deep", "tab\there", 3, -3, 2.25, 2, "u", 5, 7]]),
    ("MATCH (h:Ship {label: 'Heron'}) RETURN id(h), type(h), labels(h), degree(h), degree(h, 'CALLS'), toUpper(h.label)", [["heron", "Ship", ["Ship"], 4, 2, "HERON"]]),
    ("MATCH (a)-[x:TOWS]->(b) MATCH (a)-[y:TOWS]->(b) RETURN x = y, a = b", [[True, True]]),
    ("MATCH (a)-[x:TOWS]->(b), (c)-[y:TOWS]->(d) RETURN 1", []),
    ("MATCH (c:Cargo) RETURN c.id ORDER BY c.tons", [["tin"], ["salt"], ["cork"]]),
    ("MATCH (c:Cargo) RETURN c.id ORDER BY c.tons DESC SKIP 1", [["salt"], ["tin"]]),
    ("MATCH (s:Ship)-[:CALLS]->(p:Port) WITH s.id AS ship, collect(p.label) AS ports RETURN ship, size(ports), 'Kiel' IN ports ORDER BY ship", [["gull", 2, True], ["heron", 2, True]]),
    ("MATCH w = (:Ship {id: 'gull'})-[:CALLS]->(:Port)-[:ROUTE]->(z) RETURN nodes(w)[2].id, relationships(w)[1].days, [z.depth, 'x', TRUE]", [["kiel", 2, [9, "x", True]], ["cadiz", 6, [None, "x", True]]]),
    ("MATCH (s:Ship), (p:Port) WITH * OPTIONAL MATCH (s)-[k:CALLS]->(p) WHERE k.days > 0 WITH s, p, k WHERE k IS NOT NULL RETURN s.id, p.id, k.days", [["gull", "oslo", 1], ["heron", "kiel", 3]]),
    ("MATCH (p:Port) WHERE p.open IS NULL OR NOT p.open RETURN p.id", [["kiel"], ["cadiz"]]),
    ("MATCH (s:Ship {note: NULL}) RETURN s.id", []),
    ("MATCH (a:Port)-[:ROUTE]->(b)-[:ROUTE]->(c)-[:ROUTE]->(a) RETURN a.id, c.id ORDER BY a.id", [["cadiz", "kiel"], ["kiel", "oslo"], ["oslo", "cadiz"]]),
    ("MATCH (n:Cargo) WITH n ORDER BY n.tons DESC, n.label RETURN collect(n.id) AS ids", [[["cork", "salt", "tin"]]]),
    ("MATCH (n) RETURN n.type SKIP 5 LIMIT 2", [["Ship"], ["Cargo"]]),
    ("MATCH (s:Ship) RETURN count(*) * 10 + sum(s.knots), coalesce(min(s.tons), -1), abs(min(s.knots) - 20)", [[88, -1, 2]]),
    ("MATCH (c:Cargo) WHERE TRUE OR c.tons % 0 = 1 RETURN count(*)", [[3]]),
    ("RETURN $route.legs[0] + $route['legs'][1] AS d, $name STARTS WITH 'Os' AS s", [[8, True]]),
    ("MATCH (n) WHERE n.note CONTAINS 'a' AND NOT n.note ENDS WITH 'd' RETURN n.id", [["cadiz"]]),
    ("MATCH (s:Ship) RETURN DISTINCT s.knots AS k ORDER BY k DESC", [[22], [18]]),
    ("RETURN {a: 9007199254740993} = {a: 9007199254740992}, [[9007199254740993]] = [[9007199254740992]], 9007199254740993 = 9007199254740992.0, 9007199254740992 = 9007199254740992.0, 9007199254740993 > 9007199254740992.0", [[False, False, False, True, True]]),
    ("RETURN [1, 2][4294967296], 'ab'[-4294967297], [[1]][9223372036854775807]", [[None, None, None]]),
]


@pytest.mark.parametrize(("text", "rows"), GOLDEN)
def test_golden(graph, text, rows):
    found = GraphEngine(graph).execute(text, {"route": {"legs": [2, 6]}, "name": "Oslo"})
    assert found["rows"] == rows and found["language"] == "GraphQuery/1" and not found["truncated"]


def test_provenance_goes_through_distinct_and_aggregates(graph):
    engine = GraphEngine(graph)
    found = engine.execute("MATCH (s:Ship)-[:LOADS]->(c:Cargo) WITH DISTINCT c.label AS l WHERE l = 'Salt' RETURN l")
    assert found["graph"] == {"node_ids": ["gull", "heron", "salt"], "edge_ids": ["l1", "l2"]}
    assert engine.execute("MATCH (c:Cargo) RETURN count(*)")["graph"]["node_ids"] == ["cork", "salt", "tin"]
    assert engine.execute("RETURN 'nothing'")["graph"] == {"node_ids": [], "edge_ids": []}


def test_entities_as_json(graph):
    (row,) = GraphEngine(graph).execute("MATCH p = (a:Port)-[r:ROUTE {days: 2}]->(b) RETURN r, p, [b]")["rows"]
    assert row[0] == {"id": "r1", "source": "oslo", "target": "kiel", "type": "ROUTE", "properties": {"days": 2, "stops": ["Aarhus"]}, "$type": "relationship"}
    assert row[1]["$type"] == "path" and [n["id"] for n in row[1]["nodes"]] == ["oslo", "kiel"] and row[2][0]["$type"] == "node"


@pytest.mark.parametrize("text", ["RETURN 3 % (2 - 2)", "RETURN 4 / 0.0", "RETURN TRUE + 1", "MATCH (p:Port) RETURN p.label < p.depth", "RETURN NOT 'no'", "RETURN 2 > 1 > 0", "RETURN size(TRUE)", "RETURN toUpper([1])", "MATCH (p:Port) RETURN length(p)", "RETURN 'a' IN 'abc'", "RETURN 5 STARTS WITH 'x'", "RETURN {a: 1}[0]", "RETURN 'hull'['h']", "MATCH (s:Ship) RETURN avg(s.label)", "MATCH (s:Ship) RETURN s.id ORDER BY s", "MATCH (s:Ship) RETURN degree(s, s.knots)", "RETURN 2 LIMIT -3", "RETURN 2 SKIP 0.5", "RETURN 2 SKIP 'x'", "RETURN $absent + 1", "RETURN (7).sails", "MATCH (s:Ship) WHERE s.knots RETURN s.id"])
def test_errors_of_rows(graph, text):
    with pytest.raises(QueryError):
        GraphEngine(graph).execute(text)


def test_errors_need_rows(graph):
    assert GraphEngine(graph).execute("MATCH (x:Lighthouse) RETURN x.depth / 0 AS x")["rows"] == []
    assert GraphEngine(graph).execute("RETURN 2 - NULL, toLower(NULL), NULL['a'], NULL.sails, abs(NULL), id(NULL)")["rows"] == [[None] * 6]


def test_limits(graph):
    engine = GraphEngine(graph, QueryLimits(max_rows=2))
    found = engine.execute("MATCH (n) RETURN n.id")
    assert found["truncated"] and found["stats"]["total_rows"] == 9 and found["rows"] == [["oslo"], ["kiel"]]
    with pytest.raises(QueryLimitError):
        GraphEngine(graph, QueryLimits(max_result_bytes=7)).execute("MATCH (p:Port) RETURN p.label")
    with pytest.raises(QueryLimitError):
        engine.execute("RETURN 9223372036854775806 + 2")
    with pytest.raises(QueryLimitError):
        GraphEngine(graph, QueryLimits(max_intermediate_rows=80)).execute("MATCH (a), (b) RETURN count(*)")
    assert GraphEngine(graph, QueryLimits(max_intermediate_rows=81, timeout_seconds=60)).execute("MATCH (a), (b) RETURN count(*)")["rows"] == [[81]]
    assert found["stats"]["work"] == 27 and found["stats"]["peak_intermediate_rows"] == 9
    with pytest.raises(QueryLimitError):
        GraphEngine(graph, QueryLimits(max_steps=117)).execute("MATCH (n) WITH n MATCH (m) WHERE m.id = n.id RETURN count(*)")
    # 9 nodes, twice after a clause, 81 pairs, 9 of them left, and one row
    assert GraphEngine(graph, QueryLimits(max_steps=118)).execute("MATCH (n) WITH n MATCH (m) WHERE m.id = n.id RETURN count(*)")["stats"]["work"] == 118
    for wrong in ([1], {"a": float("nan")}, {1: 2}, {"a": object()}):
        with pytest.raises(QueryError):
            engine.execute("RETURN 1", wrong)


def test_work_inside_a_match_is_bounded(spark):
    """Rows that a WHERE leaves nothing of are counted, and the join stops at the budget."""
    many = spark.range(40_000).selectExpr("concat('n', id) id", "'x' label", "'T' type", "id ord", "named_struct('depth', id) properties")
    none = spark.createDataFrame([], "id string, source string, target string, type string, ord bigint, properties struct<days bigint>")
    own = type(make_graph(spark, [], []))(many, none)
    started = time.monotonic()
    with pytest.raises(QueryLimitError, match="too many rows in all"):
        GraphEngine(own, QueryLimits(max_intermediate_rows=100_000)).execute("MATCH (a:T), (b:T), (c:T) WHERE a.depth + b.depth + c.depth < 0 RETURN count(*)")
    assert time.monotonic() - started < 60
    with pytest.raises(QueryLimitError, match="A clause"):
        GraphEngine(own).execute("MATCH (a:T) WITH a WHERE a.depth < 25000 RETURN count(*)")


def test_work_of_trails_and_optional_matches(graph):
    engine = GraphEngine(graph)
    stats = lambda text: engine.execute(text)["stats"]
    # two ports to start from and every trail of one hop or two
    assert stats("MATCH (a:Port {id: 'oslo'})-[:ROUTE*1..2]->(b) RETURN b.id")["work"] == 1 + 1 + 2 + 2 + 2
    assert stats("MATCH (a:Port) OPTIONAL MATCH (a)-[r:ROUTE {days: 2}]->(b) RETURN a.id, b.id")["peak_intermediate_rows"] == 3
    assert stats("MATCH (a:Nothing)-[:ROUTE]->(b) RETURN b.id")["work"] == 0


def trails(edges, start, low, high, directed):
    out = []

    def walk(at, used):
        if len(used) >= low:
            out.append((start, at, len(used)))
        if len(used) < high:
            for i, s, t in edges:
                if i not in used:
                    for a, b in {(s, t)} if directed else {(s, t), (t, s)}:
                        if a == at:
                            walk(b, (*used, i))

    walk(start, ())
    return out


def test_trails_of_random_graphs(spark):
    rng = random.Random(5)
    names = list("abcde")
    edges = [(f"e{k}", rng.choice(names), rng.choice(names)) for k in range(7)] + [("loop", "a", "a")]
    own = make_graph(spark, [(n, n, "T", {}) for n in names], [(i, s, t, "X", {}) for i, s, t in edges])
    engine = GraphEngine(own)
    for arrow, directed in (("->", True), ("-", False)):
        found = engine.query(f"MATCH (a)-[e*1..3]{arrow}(b) RETURN a.id AS a, b.id AS b, size(e) AS n").collect()
        assert sorted(map(tuple, found)) == sorted(x for n in names for x in trails(edges, n, 1, 3, directed))
    both = engine.query("MATCH (a)-[x]->(b), (b)-[y]->(c) RETURN a.id AS a, b.id AS b, c.id AS c").collect()
    assert sorted(map(tuple, both)) == sorted((s, t, u) for i, s, t in edges for j, v, u in edges if t == v and i != j)


def test_mixed_properties(spark, tmp_path):
    from quiverql.sources import graph_json

    (tmp_path / "g.json").write_text('{"schema_version": 1, "metadata": {"title": "t"}, "nodes": [{"id": "a", "label": "x", "type": "M", "properties": {"v": 1}, "extra": 5}, {"id": "b", "label": "y", "type": "M", "properties": {"v": "1"}}, {"id": "c", "label": "z", "type": "M"}], "edges": []}')
    engine = GraphEngine(graph_json.load_json(spark, str(tmp_path / "g.json")))
    assert engine.execute("MATCH (m) RETURN m.v, m.v = 1, m.v = '1', m.extra")["rows"] == [[1, True, False, 5], ["1", False, True, None], [None, None, None, None]]
    assert engine.execute("MATCH (m) RETURN DISTINCT m.v")["rows"] == [[1], ["1"], [None]]
    with pytest.raises(QueryError):
        engine.execute("MATCH (m) RETURN m.v + 1")


MIXED = """{"schema_version": 1, "metadata": {}, "edges": [{"id": "e", "source": "a", "target": "b", "type": "N", "properties": {"w": [1, 2.5]}}], "nodes": [
 {"id": "a", "label": "1", "type": "A", "properties": {"v": 1, "w": 9007199254740993, "f": [0.5, 2], "b": [true, null], "l": [1, "z", null], "m": {"k": [1, 2], "n": null}, "s": "q", "t": "N"}},
 {"id": "b", "label": "2", "type": "A", "properties": {"v": 2, "w": 9007199254740992.0, "f": [], "b": [], "l": ["y"], "m": {}, "s": "d", "t": 3}},
 {"id": "c", "label": "3", "type": "B", "properties": {"v": "q", "w": -2.5, "f": "none", "s": [1]}},
 {"id": "d", "label": "4", "type": "B", "properties": {"v": "d", "w": 7, "s": [2]}},
 {"id": "e", "label": "5", "type": "C", "properties": {"v": true, "w": 9223372036854775807}},
 {"id": "f", "label": "6", "type": "C"}]}"""


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    from quiverql.sources import graph_json

    where = tmp_path_factory.mktemp("mixed") / "g.json"
    where.write_text(MIXED)
    return GraphEngine(graph_json.load_json(spark, str(where)))


EXACT = 9007199254740993
OF_SEVERAL_KINDS = [
    ("MATCH (n:A) RETURN n.v + 1, n.v - 1, n.v * 3, n.v / 2, n.v % 2, -n.v, abs(0 - n.v) ORDER BY n.v", [[2, 0, 3, 0.5, 1, -1, 1], [3, 1, 6, 1.0, 0, -2, 2]]),
    ("MATCH (n:A) RETURN n.w + 0, n.w - 1 ORDER BY n.w", [[9007199254740992.0, 9007199254740991.0], [EXACT, EXACT - 1]]),
    ("MATCH (n {id: 'c'}) RETURN n.w % 2, n.w % 2.0, -n.w, abs(n.w), n.w * 2, 5 % n.w", [[1.5, 1.5, 2.5, 2.5, -5.0, -0.0]]),
    ("RETURN [1, 'a'][0] + 1, ['a', 1][0] + 'b', 3 / [2, 'x'][0], [7, 'x'][0] % -4, ['ab', 1][0] + ['c', 2][0], [1, 'a'][0] + 0.5", [[2, "ab", 1.5, -1, "abc", 1.5]]),
    ("MATCH (n:A) RETURN sum(n.v), avg(n.v), min(n.v), max(n.v), sum(DISTINCT n.v), sum(n.w) > 0", [[3, 1.5, 1, 2, 3, True]]),
    ("MATCH (n:B) RETURN min(n.v), max(n.v), count(n.v), count(DISTINCT n.w)", [["d", "q", 2, 2]]),
    ("MATCH (n) RETURN max(n.w), min(n.w), count(n.w)", [[2**63 - 1, -2.5, 5]]),
    ("MATCH (n:A) RETURN max(n.w), min(n.w), avg(n.w)", [[EXACT, 9007199254740992.0, 9007199254740992.0]]),
    ("MATCH (n) WHERE n.type = 'A' OR n.id = 'd' RETURN sum(n.w) - 7, sum(DISTINCT n.w) - 7", [[18014398509481984.0, 18014398509481984.0]]),
    ("MATCH (n:C) RETURN min(n.v), max(n.v)", [[True, True]]),
    ("MATCH (n:Nothing) RETURN sum(n.v), avg(n.v), min(n.v), max(n.w)", [[0, None, None, None]]),
    ("MATCH (n:B) RETURN n.v ORDER BY n.v", [["d"], ["q"]]),
    ("MATCH (n:B) RETURN n.v ORDER BY n.v DESC", [["q"], ["d"]]),
    ("MATCH (n) RETURN n.id ORDER BY n.w", [["c"], ["d"], ["b"], ["a"], ["e"], ["f"]]),
    ("MATCH (n) RETURN n.id ORDER BY n.w DESC SKIP 1 LIMIT 2", [["e"], ["a"]]),
    ("MATCH (n) WHERE n.type <> 'C' RETURN n.id ORDER BY n.type DESC, n.v", [["d"], ["c"], ["a"], ["b"]]),
    ("MATCH (n) WITH n ORDER BY n.w RETURN collect(n.w) AS w", [[[-2.5, 7, 9007199254740992.0, EXACT, 2**63 - 1]]]),
    ("MATCH (n:A) RETURN size(n.f), 0.5 IN n.f, 2.0 IN n.f, size(n.b), TRUE IN n.b, 3 IN n.f ORDER BY n.id", [[2, True, True, 2, True, False], [0, False, False, 0, False, False]]),
    ("MATCH (n {id: 'a'}) RETURN 'z' IN n.l, size(n.l), 1 IN n.l, 5 IN n.l, size(n.m), size(n.m.k), n.m.k[1] + 1, 2 IN n.m.k, n.m.n, FALSE IN n.b", [[True, 3, True, None, 2, 2, 3, True, None, None]]),
    ("MATCH (n {id: 'c'}) RETURN size(n.f), n.f + '!', toUpper(n.v), n.f CONTAINS 'on'", [[4, "none!", "Q", True]]),
    ("MATCH (n) WHERE n.w > 9007199254740992 AND n.w < 9007199254740994 RETURN n.id, n.w = 9007199254740993, n.w >= 9007199254740993.0", [["a", True, True]]),
    ("MATCH (n) WHERE n.w >= 9223372036854775807 RETURN n.id", [["e"]]),
    ("MATCH ()-[e]->() RETURN e.w[0], e.w[1], e.w[0] + 1, size(e.w), 1.0 IN e.w", [[1, 2.5, 2, 2, True]]),
    ("MATCH (n {id: 'a'}) RETURN degree(n, n.t)", [[1]]),
    ("MATCH (n:A) RETURN n.v LIMIT [1, 'x'][0]", [[1]]),
    ("MATCH (n:C) RETURN n.v AND TRUE, NOT n.v ORDER BY n.id", [[True, False], [None, None]]),
]


@pytest.mark.parametrize(("text", "rows"), OF_SEVERAL_KINDS)
def test_values_of_several_kinds(mixed, text, rows):
    found = mixed.execute(text)["rows"]
    assert found == rows and repr(found) == repr(rows)


@pytest.mark.parametrize("text", ["MATCH (n) RETURN n.id ORDER BY n.v", "MATCH (n) RETURN n.id ORDER BY n.type, n.s", "MATCH (n) RETURN min(n.v)", "MATCH (n) RETURN max(n.s)", "MATCH (n) RETURN sum(n.v)", "MATCH (n) RETURN avg(n.s)", "MATCH (n) RETURN n.v + 1", "MATCH (n) RETURN -n.v", "MATCH (n) RETURN abs(n.v)", "MATCH (n) RETURN size(n.w)", "MATCH (n) RETURN 1 IN n.v", "MATCH (n) RETURN n.v < 2", "MATCH (n:A) RETURN n.v % (n.v - 1)", "MATCH (n:A) RETURN degree(n, n.t)", "MATCH (n:B) RETURN n.id LIMIT ['x', 1][0]", "MATCH (n:B) RETURN n.id ORDER BY n.s", "RETURN [9223372036854775807, 'x'][0] + 1"])
def test_errors_of_several_kinds(mixed, text):
    with pytest.raises(QueryError):
        mixed.execute(text)


def test_ties_before_a_key_of_several_kinds(mixed):
    # rows that an earlier key tells apart never meet in the later one
    assert mixed.execute("MATCH (n) WHERE n.v IS NOT NULL RETURN n.id ORDER BY n.id, n.v")["rows"] == [[x] for x in "abcde"]


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("text", [
    "MATCH (n:Cargo) WITH n ORDER BY n.tons DESC, n.label RETURN collect(n.id) AS ids",
    "MATCH (n) WITH n ORDER BY n.type DESC, n.label MATCH (n)-[r]->(m) WITH n, m ORDER BY m.label RETURN n.type AS t, collect(n.id + m.id) AS ids, collect(DISTINCT m.id) AS ms",
    "MATCH (n) WITH n.open AS o, n.label AS l ORDER BY o DESC, l RETURN collect(l) AS ls, collect(o) AS os",
    "MATCH (n) WITH n.depth AS d, n.id AS i ORDER BY d DESC, i DESC WITH i ORDER BY size(i) RETURN collect(i) AS ids",
    "MATCH (n:Ship) WITH n ORDER BY n.knots DESC, n.id OPTIONAL MATCH (n)-[c:CALLS]->(p:Port) WHERE c.days > 0 RETURN n.id AS n, collect(p.id) AS ports",
    "MATCH (a:Ship), (b:Ship) WITH a, b ORDER BY b.id DESC, a.id OPTIONAL MATCH (a)-[:LOADS]->(c)<-[:LOADS]-(b) RETURN collect(a.id + b.id) AS pairs, collect(c.id) AS cs",
])
def test_order_needs_no_task_of_its_own(graph, text):
    """Rows ordered by WITH keep the order, which no window without partitions makes; execute and query agree."""
    engine = GraphEngine(graph)
    frame = engine.query(text)
    assert "Window" not in plan(frame)
    want = engine.execute(text)["rows"]
    assert sorted(map(repr, ([*r] for r in frame.collect()))) == sorted(map(repr, want)) and want


def test_orders_by_hand(graph):
    rows = GraphEngine(graph).execute("MATCH (n) WITH n ORDER BY n.type DESC, n.label RETURN collect(n.id) AS ids")["rows"]
    assert rows == [[["gull", "heron", "tern", "cadiz", "kiel", "oslo", "salt", "tin", "cork"]]]
    rows = GraphEngine(graph).execute("MATCH (n:Port) WITH n.open AS o, n.id AS i ORDER BY o DESC, i WITH i, o RETURN collect(i) AS ids, collect(o) AS os")["rows"]
    assert rows == [[["cadiz", "oslo", "kiel"], [True, False]]]
    rows = GraphEngine(graph).execute("MATCH (n) WITH n.note AS t, n.id AS i ORDER BY t DESC, i DESC LIMIT 8 WITH i SKIP 5 RETURN collect(i) AS ids")["rows"]
    assert rows == [[["cork", "cadiz", "gull"]]]


ANTI = "MATCH (c:Cargo) OPTIONAL MATCH (s:Ship)-[l:LOADS]->(c) {} WITH c, count({}) AS n WHERE n = 0 {} RETURN c.id AS id, n"


@pytest.mark.parametrize(("text", "anti"), [
    (ANTI.format("", "s", ""), True), (ANTI.format("WHERE s.knots > 20", "l", ""), True), (ANTI.format("", "s", "AND c.tons IS NULL"), True), (ANTI.format("", "DISTINCT s", ""), True),
    (ANTI.format("", "*", ""), False), (ANTI.format("", "s.knots", ""), False), (ANTI.format("", "s", "OR c.tons > 1"), False),
    ("MATCH (c:Cargo) OPTIONAL MATCH (s:Ship)-[:LOADS]->(c) WITH c.label AS c, count(s) AS n WHERE n = 0 RETURN c AS id, n", False),
    ("MATCH (c:Cargo) OPTIONAL MATCH (s:Ship)-[:LOADS]->(c) WITH c.id AS c, s.id AS x, count(s) AS n WHERE n = 0 RETURN c AS id, n", False),
    ("MATCH (c:Cargo), (x:Port) OPTIONAL MATCH (s:Ship)-[:LOADS]->(c) WITH id(c) AS i, x.open AS o, count(s) AS n WHERE n = 0 RETURN i AS id, n", True),
    ("MATCH (c:Cargo) OPTIONAL MATCH (s)-[ls:LOADS*1..2]->(c) RETURN c.id AS id, count(ls) AS n", False),
])
def test_counts_of_nothing_are_anti_joins(graph, text, anti):
    engine = GraphEngine(graph)
    frame = engine.query(text)
    assert ("LeftAnti" in plan(frame)) == anti
    assert sorted(map(list, frame.collect())) == sorted(engine.execute(text)["rows"])


@pytest.mark.parametrize(("text", "semi"), [
    ("MATCH (s:Ship) MATCH (s)-[:CALLS]->(p:Port) RETURN DISTINCT s.id AS id", True), ("MATCH (s:Ship) MATCH (s)-[c:CALLS]->(p:Port) WHERE c.days > 1 AND p.open = FALSE RETURN DISTINCT s.id AS id", True),
    ("MATCH (s:Ship) MATCH (s)-[:CALLS]->(p:Port) RETURN max(s.knots) AS id", True), ("MATCH (s:Ship) MATCH (s)-[:CALLS]->(p:Port) WITH count(DISTINCT s) AS n RETURN n AS id", True),
    ("MATCH (s:Ship) MATCH (s)-[:CALLS]->(p:Port) RETURN s.id AS id", False), ("MATCH (s:Ship) MATCH (s)-[:CALLS]->(p:Port) RETURN DISTINCT p.id AS id", False), ("MATCH (s:Ship) MATCH (s)-[:CALLS]->(p:Port) RETURN count(s) AS id", False),
    ("MATCH (s:Ship) MATCH (s)-[:CALLS]->(p:Port) WITH DISTINCT s MATCH (s)-[:LOADS]->(c) RETURN c.id AS id", True), ("MATCH (s:Ship) MATCH (s)-[:CALLS]->(p:Port) WITH DISTINCT * RETURN s.id AS id", False),
])
def test_matches_that_only_ask_are_semi_joins(graph, text, semi):
    engine = GraphEngine(graph)
    frame = engine.query(text)
    assert ("LeftSemi" in plan(frame)) == semi
    assert sorted(map(list, frame.collect())) == sorted(engine.execute(text)["rows"])


def test_optional_patterns_start_at_the_rows_nodes(graph):
    """Rows that are few make the optional pattern from their own nodes, distinct ones; all of a type make it once for all."""
    engine = GraphEngine(graph)
    for text, around in (("MATCH (s:Ship {id: 'gull'}) OPTIONAL MATCH (s)-[c:CALLS]->(p:Port) RETURN s.id AS s, p.id AS p", True), ("MATCH (s:Ship) OPTIONAL MATCH (s)-[c:CALLS]->(p:Port) RETURN s.id AS s, p.id AS p", False), ("MATCH (s:Ship)-[:LOADS]->() OPTIONAL MATCH (p:Port)<-[c:CALLS]-(s) WHERE c.days IS NULL RETURN s.id AS s, p.id AS p", True)):
        frame = engine.query(text)
        assert ("Aggregate" in plan(frame)) == around
        assert sorted(map(repr, ([*r] for r in frame.collect()))) == sorted(map(repr, engine.execute(text)["rows"]))


def test_export_of_entities_lists_and_paths(graph, tmp_path):
    """Lines hold what execute returns, in any order."""
    engine = GraphEngine(graph)
    for k, text in enumerate(["MATCH p = (s:Ship)-[:CALLS]->(:Port)-[:ROUTE*0..1]->(x) RETURN p, s, nodes(p) AS ns, x.label AS label", "MATCH (c:Cargo) OPTIONAL MATCH (c)<-[l:LOADS]-(s) RETURN c, l, s.knots AS k", "MATCH (c:Cargo) OPTIONAL MATCH q = (c)<-[ls:LOADS*1..2]-(s {id: 'heron'}) RETURN c.id AS i, q, ls, collect(s) AS all", "MATCH (n:Nothing) RETURN n"]):
        engine.export(text, str(tmp_path / str(k)))
        rows = [json.loads(line) for file in (tmp_path / str(k)).glob("part-*") for line in file.read_text().splitlines()]
        found = engine.execute(text)
        assert sorted((json.dumps(r, sort_keys=True) for r in rows)) == sorted(json.dumps(dict(zip(found["columns"], r, strict=True)), sort_keys=True) for r in found["rows"])


@pytest.mark.parametrize(
    ("first", "second", "asked"),
    [
        ("(p:Port)<-[:CALLS]-(s:Ship)", "(p)-[:ROUTE]->(q:Port)", "p.id AS a, count(*) AS n, count(q.depth) AS k, sum(s.knots / 2 + q.depth / 4) AS t, sum(q.depth / 4 - s.knots / 2) AS u, min(q.label) AS l, max(s.knots) AS m"),
        ("(s:Ship)-[c:CALLS]->(p:Port)", "(s)-[l:LOADS]->(g)", "g.id AS a, count(c) AS n, count(g.tons) AS k, sum(p.depth / 3 - g.tons / 7) AS t, sum(g.tons / 7) AS u, max(p.id) AS l, min(c.days) AS m"),
        ("(p)<-[:CALLS]-(s:Ship)", "(p)<-[:ROUTE]-(q:Port {open: FALSE})", "1 AS a, count(*) AS n, count(s) AS k, sum(q.depth / 4) AS t, sum(s.knots / 4) AS u, min(q.depth) AS l, max(s.note) AS m"),
        ("(p:Port)<-[:CALLS]-(s {note: 'none'})", "(p)-[:ROUTE]->(q)", "count(*) AS a, count(q.depth) AS n, 1 AS k, sum(s.knots / 2 + q.depth / 4) AS t, 2 AS u, min(q.id) AS l, 3 AS m"),
    ],
)
def test_patterns_that_are_only_counted_make_no_pairs(graph, first, second, asked):
    engine, order = GraphEngine(graph), " ORDER BY a"
    folded = engine.query(f"MATCH {first}, {second} RETURN {asked}")
    pairs = engine.query(f"MATCH {first} MATCH {second} RETURN {asked}{order}")
    got, wanted = ([[pytest.approx(v) if isinstance(v, float) else v for v in r] for r in f.orderBy("a").collect()] for f in (folded, pairs))
    assert got == wanted
    assert folded._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2


@pytest.mark.parametrize("text", ["MATCH (p:Port)<-[:CALLS]-(s), (p)<-[:CALLS]-(t) RETURN p.id AS p, count(*) AS n", "MATCH (p:Port)<-[:CALLS]-(s:Ship), (p)-[:ROUTE]->(q) RETURN s.id AS s, q.id AS q, count(*) AS n", "MATCH (p:Port)<-[:CALLS]-(s:Ship), (p)-[:ROUTE]->(q) RETURN p.id AS p, sum(s.knots * q.depth) AS n"])
def test_patterns_whose_pairs_count_are_made(graph, text):
    rows = [list(r) for r in GraphEngine(graph).query(text).orderBy(*(["p"] if "AS p" in text else ["s", "q"])).collect()]
    assert rows == GraphEngine(graph).execute(text + (" ORDER BY p" if "AS p" in text else " ORDER BY s, q"))["rows"]


def test_a_sum_of_folded_pairs_fails_where_a_pair_does(spark):
    big = make_graph(spark, [("n", "N", "Hub", {}), ("a", "A", "Left", {"w": 1.7e308}), ("b", "B", "Right", {"w": 1.7e308}), ("c", "C", "Right", {"w": -1.7e308})], [("x", "a", "n", "IN", {}), ("y", "b", "n", "IN", {}), ("z", "c", "n", "IN", {})], "w double")
    with pytest.raises(Exception, match="too large"):
        GraphEngine(big).query("MATCH (n)<-[:IN]-(l:Left), (n)<-[:IN]-(r:Right) RETURN sum(l.w + r.w) AS t").collect()


def test_equal_values_meet_in_lists(spark, monkeypatch):
    """Rows of a frequent value meet in several places and as lists; a scan that WHERE asks nothing equal of meets all, and so do whole numbers and floats."""
    from quiverql.plans import compiler

    monkeypatch.setattr(compiler, "FEW", 5)
    monkeypatch.setattr(compiler, "RUN", 2)
    values = [None if k % 11 == 0 else k % 7 if k % 3 else 0 for k in range(60)]
    nodes = [(f"n{k}", f"N{k % 4}", "A" if k % 2 else "B", {"depth": v, "note": None if v is None else f"x{v}"}) for k, v in enumerate(values)]
    graph = make_graph(spark, nodes, [])
    engine = GraphEngine(graph)

    def asked(text):
        frame = engine.query(text)
        return sorted(map(tuple, frame.collect())), "inline(" in frame._jdf.queryExecution().optimizedPlan().toString()

    pairs = [(a, b) for a in nodes for b in nodes if a[3]["depth"] is not None and a[3]["depth"] == b[3]["depth"]]
    for key in ("depth", "note"):
        assert asked(f"MATCH (a), (b:A) WHERE a.{key} = b.{key} AND a.id < b.id RETURN a.id AS a, b.id AS b, b.label AS c") == (sorted((a[0], b[0], b[1]) for a, b in pairs if b[2] == "A" and a[0] < b[0]), True)
    assert asked("MATCH (a:B) MATCH (b:A) WHERE b.depth = a.depth RETURN a.id AS a, b.id AS b") == (sorted((a[0], b[0]) for a, b in pairs if (a[2], b[2]) == ("B", "A")), True)
    assert asked("MATCH (a:B), (b:A) WHERE a.depth = b.depth OR a.id = b.id RETURN a.id AS a, b.id AS b") == (sorted((a[0], b[0]) for a, b in pairs if (a[2], b[2]) == ("B", "A")), False)
    assert len(asked("MATCH (a:B), (b:A) WHERE a.depth < b.depth RETURN a.id AS a")[0]) == sum(a[2] == "B" and b[2] == "A" and None not in (x := (a[3]["depth"], b[3]["depth"])) and x[0] < x[1] for a in nodes for b in nodes)
