import pytest

from quiverql import QueryError, QueryLimitError
from quiverql.plans.analysis import analyse
from quiverql.plans.parser import parse
from quiverql.plans.syntax import Binary, Literal, Unary

REJECTED = [
    "", "  // nothing", "MATCH (p:Port)", "RETURN", "MERGE (p:Port) RETURN p", "MATCH (p) SET p.depth = 3", "MATCH (p) RETURN q.depth", "MATCH (a)-[:ROUTE*]-(b) RETURN b", "MATCH (a)-[:ROUTE*2..]->(b) RETURN b", "MATCH (a)<-[:ROUTE*4..3]-(b) RETURN b", "MATCH (a)-[:ROUTE*7]->(b) RETURN b",
    "RETURN sail(1)", "RETURN abs()", "RETURN abs(1, 2)", "RETURN abs(DISTINCT 1)", "RETURN max(*)", "MATCH (p) RETURN count(DISTINCT *)", "RETURN *", "MATCH (p) RETURN p.id ORDER BY max(p.depth)", "MATCH (p) RETURN p SKIP p.depth", "MATCH (p)-[p]-(q) RETURN q", "MATCH (p {depth: q.depth}) RETURN p", "RETURN {up: 1, up: 2}", "RETURN '\\z'", "RETURN 5.", "RETURN ~1",
    "MATCH (p) RETURN DISTINCT p.type AS t ORDER BY p.label", "MATCH (a)<-[:ROUTE]->(b) RETURN b", "MATCH (p) OPTIONAL RETURN p", "MATCH (a)-->(b RETURN b",
    # each of these faults in a statement that is right otherwise
    "MATCH (s:Ship)-[c:CALLS]->(p:Port) WHERE c.days > 1 RETURN s.label AS name, p.depth AS depth, p.label AS name ORDER BY depth",
    "MATCH (s:Ship) WHERE s.knots > 10 RETURN s.label AS ship LIMIT 3; MATCH (p:Port) RETURN p.label AS port",
    "MATCH (s:Ship) RETURN s.label AS ship MATCH (p:Port {open: TRUE}) RETURN p.label AS port",
    "MATCH (s:Ship)-[:LOADS]->(c:Cargo) WITH s, c.tons, c.label AS what WHERE what <> 'Tin' RETURN s.id AS s, what",
    "MATCH (s:Ship)-[:LOADS]->(c:Cargo) WHERE c.tons > 20 AND count(c) >= 2 RETURN s.label AS ship, c.label AS cargo",
    "MATCH (s:Ship)-[:LOADS]->(c:Cargo) RETURN s.label AS ship, avg(count(c) + 1) AS mean ORDER BY mean DESC",
    "MATCH (s:Ship)-[:LOADS]->(c:Cargo) WITH s, c RETURN s.id AS ship, s.knots * 2 - min(c.tons) AS room",
    "MATCH (p:Port) WHERE p.note STARTS WITH \"Deep AND p.open RETURN p.id AS port",
    "MATCH (p:Port) WHERE p.depth >= 9 AND p.depth - 3 < RETURN p.id AS port, p.depth AS depth",
    "MATCH (p:Port) WHERE p.depth < 12 RETURN p.depth * 1" + "0" * 20 + "e300 AS deep",
]


@pytest.mark.parametrize("text", REJECTED)
def test_rejected(text):
    with pytest.raises(QueryError):
        analyse(parse(text))


def test_limits():
    for text in ("RETURN " + "1" * 16_000, "RETURN [" + "1," * 4_000 + "1]", "RETURN " + "(" * 60 + "1" + ")" * 60, "MATCH (n) " * 24 + "RETURN n", "MATCH (n)" + ", (n)" * 12 + " RETURN n", "MATCH (n)" + "--()" * 13 + " RETURN n"):
        with pytest.raises(QueryLimitError):
            parse(text)


def test_place_of_an_error():
    text = "MATCH (p:Port)\n\n  WITH p.depth AS d\nRETURN d + keel"
    with pytest.raises(QueryError) as e:
        analyse(parse(text))
    assert e.value.details(text) == {"message": str(e.value), "code": "QUERY_ERROR", "position": text.index("keel"), "line": 4, "column": 12}


def expression(text):
    return parse(f"RETURN {text}")[0].items[0][0]


def test_levels():
    assert expression("NOT 1 = 2") == Unary("NOT", Binary("=", Literal(1), Literal(2)))
    assert expression("1 + 2 * 3") == Binary("+", Literal(1), Binary("*", Literal(2), Literal(3)))
    assert expression("1 - 2 - 3") == Binary("-", Binary("-", Literal(1), Literal(2)), Literal(3))
    assert expression("TRUE OR FALSE AND NULL") == Binary("OR", Literal(True), Binary("AND", Literal(False), Literal(None)))
    assert expression("-1 IS NOT NULL") == Unary("IS NOT NULL", Unary("-", Literal(1)))
    assert expression("'St ''Ives' <> \"\\t\"") == Binary("!=", Literal("St 'Ives"), Literal("\t"))


def test_names_and_comments():
    clauses = parse("MATCH (`a b`:T)-->(return) // to the end\n WHERE `a b`.x /* in\nbetween */ = 1 RETURN `a b` AS `x``y`;")
    assert clauses[0].patterns[0].nodes[0].name == "a b" and clauses[-1].items[0][1] == "x`y"
    assert parse("RETURN  1 +  2")[0].items[0][1] == "1 +  2"
