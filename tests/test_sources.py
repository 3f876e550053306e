import io
import json
import random
import re
import zipfile
from dataclasses import replace

import pytest
from conftest import make_graph
from pyspark.sql import functions as F

from quiverql import GraphEngine
from quiverql.operators import analytics, extraction, tools
from quiverql.sources import docx, graph_json, results

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def word(body, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
        for name, text in parts.items():
            z.writestr(f"word/{name}.xml", text)
    return out.getvalue()


def paragraph(*texts, style=None):
    runs = "<w:tab/>".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in texts)
    return f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}{runs}</w:p>'


def row(*cells):
    return "<w:tr>" + "".join(f"<w:tc>{paragraph(c) if c else '<w:p/>'}</w:tc>" for c in cells) + "</w:tr>"


BODY = f'<w:document {W}><w:body>{paragraph("Currents shape harbours.")}{paragraph("Tides", style="Heading2")}<w:tbl>{row("Pilot", "", "Neap tide")}{row("Buoy")}{row("")}</w:tbl>{paragraph("Pilots", "read currents.")}</w:body></w:document>'


def test_docx_to_graph(spark, tmp_path):
    (tmp_path / "log.docx").write_bytes(word(BODY))
    blocks = docx.read_docx(spark, str(tmp_path)).cache()
    want = [(1, "Currents shape harbours.", "paragraph", None, None), (2, "Tides", "paragraph", 2, None), (3, "Pilot |  | Neap tide", "table_row", None, 1), (4, "Buoy", "table_row", None, 2), (5, "Pilots read currents.", "paragraph", None, None)]
    assert [(r.position, r.text, r.kind, r.level, r.row) for r in blocks.orderBy("position").collect()] == want
    made = extraction.build_graph(blocks)
    graph_json.validate(made)
    assert {r.type: r["count"] for r in made.nodes.groupBy("type").count().collect()} == {"Document": 1, "Section": 1, "Passage": 4, "Concept": 10}
    currents = made.nodes.where("label = 'currents'").first()
    assert currents.properties.occurrences == 2 and currents.properties.passage_count == 2
    links = made.edges.where("type = 'CO_OCCURS_WITH'").collect()
    assert len(links) == 9 and all(r.properties.weight == 1 == len(r.properties.evidence) for r in links)


@pytest.mark.parametrize("raw", [b"", b"no zip", word("<broken"), word(f"<!DOCTYPE x>{BODY}"), word(('<?xml version="1.0" encoding="UTF-16"?><!DOCTYPE x [<!ENTITY a "b">]>' + BODY).encode("utf-16")), word(f"<w:document {W}/>"), word(f"<w:document {W}><w:body/></w:document>")])
def test_bad_docx(raw):
    with pytest.raises(ValueError):
        docx.blocks(raw)


def test_heading_styles_and_levels():
    styles = f'<w:styles {W}><w:style w:styleId="X"><w:name w:val="heading 2"/></w:style></w:styles>'
    body = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="X"/></w:pPr><w:r><w:t>A</w:t></w:r></w:p><w:p><w:pPr><w:outlineLvl w:val="3"/></w:pPr><w:r><w:t>B</w:t></w:r></w:p></w:body></w:document>'
    assert [b["level"] for b in docx.blocks(word(body, styles=styles))] == [2, 4]


def test_section_parents(spark):
    levels = [1, 2, None, 3, None, 2, None, 1, None, 3, None]
    rows = [("f", "d", k, f"t{k}", "paragraph", v, None, None) for k, v in enumerate(levels, 1)]
    placed = extraction.placed(spark.createDataFrame(rows, docx.BLOCKS)).orderBy("position").collect()
    at = {r.node_id: r.position for r in placed}
    assert [at.get(r.parent, 0) for r in placed] == [0, 1, 2, 2, 4, 1, 6, 0, 8, 8, 10]


def test_scores_by_hand(spark):
    import math

    lines = ["Pilot buoy pilot", "buoy Tide", "the and PilotX"]
    blocks = extraction.placed(spark.createDataFrame([("f", "d", k, t, "paragraph", None, None, None) for k, t in enumerate(lines, 1)], docx.BLOCKS))
    counts = extraction.term_counts(blocks)
    terms = {r.term: r for r in extraction.scored(counts, blocks).collect()}
    assert set(terms) == {"pilot", "buoy", "tide", "pilotx"} and terms["pilotx"].label == "PilotX" and terms["pilot"].label == "pilot"
    assert terms["pilot"].score == pytest.approx((1 + math.log(2)) * (1 + math.log(4 / 2))) and terms["buoy"].score == pytest.approx((1 + math.log(2)) * (1 + math.log(4 / 3)))
    found = extraction.mentions(counts, extraction.scored(counts, blocks), per_passage=1)
    assert {(r.position, r.term) for r in found.collect()} == {(1, "pilot"), (2, "tide"), (3, "pilotx")}


BAD = ['{"schema_version": 2, "nodes": [], "edges": []}', '{"schema_version": 1, "nodes": [], "edges": []}', '{"schema_version": 1, "nodes": [{"id": "a", "label": "a", "type": "T"}]}', '{"schema_version": 1, "nodes": [{"id": "a", "label": "a", "type": "T"}, {"id": "a", "label": "b", "type": "T"}], "edges": []}', '{"schema_version": 1, "nodes": [{"id": "a", "label": " ", "type": "T"}], "edges": []}', '{"schema_version": 1, "nodes": [{"id": "a", "label": "a", "type": "T"}], "edges": [{"id": "e", "source": "a", "target": "b", "type": "T"}]}', '{"schema_version": 1, "nodes": [{"id": "a", "label": "a", "type": "T", "properties": {"x": NaN}}], "edges": []}', '{"schema_version": 1, "nodes": [{"id": 1, "label": "a", "type": "T"}], "edges": []}', "{broken", "[]"]


@pytest.mark.parametrize("text", BAD)
def test_bad_json(spark, tmp_path, text):
    (tmp_path / "g.json").write_text(text)
    with pytest.raises(ValueError):
        graph_json.load_json(spark, str(tmp_path / "g.json"))


def test_json_values_that_look_like_none(spark, tmp_path):
    for k, (label, number, good) in enumerate([("Infinity", "1", True), ("NaN, -Infinity", "-2.5", True), ('a \\" 1e999', "3", True), ("x", "1e999", False), ("x", "[1, -2e400]", False)]):
        (tmp_path / f"{k}.json").write_text(f'{{"schema_version": 1, "nodes": [{{"id": "a", "label": "{label}", "type": "Infinity", "properties": {{"x": {number}}}}}], "edges": []}}')
        if good:
            assert graph_json.load_json(spark, str(tmp_path / f"{k}.json")).nodes.first().type == "Infinity"
        else:
            with pytest.raises(ValueError):
                graph_json.load_json(spark, str(tmp_path / f"{k}.json"))


def test_round_trips(spark, graph, tmp_path):
    graph_json.save(graph, str(tmp_path / "p"))
    again = graph_json.load(spark, str(tmp_path / "p"))
    assert sorted(again.nodes.select(*graph.nodes.columns).collect()) == sorted(graph.nodes.collect())
    graph_json.export_json(graph, str(tmp_path / "j"))
    (file,) = (tmp_path / "j").glob("part-*.txt")
    read = graph_json.load_json(spark, str(file))
    assert read.nodes.count() == 9 and read.edges.where("id = 'r1'").first().properties.stops == ["Aarhus"]


@pytest.fixture(scope="module")
def papers(spark):
    """A report whose second section lies in the first; one concept is nowhere mentioned."""
    nodes = [
        ("report", "Harbour report", "Document", {}), ("intro", "Intro", "Section", {}), ("p1", "Opening", "Passage", {"text": "Currents shape harbours."}), ("tides", "Tides", "Section", {}),
        ("p2", "Ebb", "Passage", {"text": "Spring tides need pilots."}), ("p3", "Flood", "Passage", {"text": "PILOTS read currents."}),
        ("currents", "currents", "Concept", {}), ("pilots", "pilots", "Concept", {}), ("harbours", "harbours", "Concept", {}), ("kelp", "kelp", "Concept", {}),
    ]
    edges = [
        ("a1", "report", "intro", "CONTAINS", {}), ("a2", "intro", "p1", "CONTAINS", {}), ("a3", "intro", "tides", "CONTAINS", {}), ("a4", "tides", "p2", "CONTAINS", {}), ("a5", "tides", "p3", "CONTAINS", {}),
        ("m1", "p1", "currents", "MENTIONS", {}), ("m2", "p1", "harbours", "MENTIONS", {}), ("m3", "p2", "pilots", "MENTIONS", {}), ("m4", "p3", "pilots", "MENTIONS", {}), ("m5", "p3", "currents", "MENTIONS", {}),
        ("w1", "currents", "harbours", "CO_OCCURS_WITH", {"evidence": ["p1"]}), ("w2", "pilots", "currents", "CO_OCCURS_WITH", {"weight": 3, "evidence": ["p3", "p2"]}),
    ]
    return make_graph(spark, nodes, edges, "text string, score bigint", "weight bigint, evidence array<string>")


def test_analytics(papers):
    g = papers
    assert analytics.shortest_path(g, "report", "pilots") == ["report", "intro", "p1", "currents", "pilots"]
    assert analytics.shortest_path(g, "pilots", "report", directed=True) == [] == analytics.shortest_path(g, "report", "kelp")
    assert analytics.shortest_path(g, "harbours", "pilots", directed=True) == ["harbours", "currents", "pilots"] and analytics.shortest_path(g, "p2", "p2") == ["p2"]
    assert {r.id: r.depth for r in analytics.k_hop(g, "tides", 2).collect()} == {"tides": 0, "intro": 1, "p2": 1, "p3": 1, "report": 2, "p1": 2, "pilots": 2, "currents": 2}
    # currents is mentioned once in either section
    assert {r.id: r.cluster for r in analytics.clusters(g).collect()} == {"report": None, "intro": "intro", "p1": "intro", "tides": "tides", "p2": "tides", "p3": "tides", "currents": "intro", "pilots": "tides", "harbours": "intro", "kelp": None}
    assert [(r.id, r.depth) for r in analytics.bands(g).collect()] == [("report", 0), ("intro", 1), ("p1", 2), ("tides", 2), ("currents", 3), ("harbours", 3), ("p2", 3), ("p3", 3), ("pilots", 4), ("kelp", 5)]
    assert [r.id for r in analytics.top_degrees(g, 3).collect()] == ["currents", "p3", "intro"]
    assert analytics.heaviest(g).first().weight == 3 and [r.id for r in analytics.evidence(g, "w2").collect()] == ["p3", "p2"]
    assert analytics.enabled_edges(g, None, 2).count() == 11 and analytics.enabled_edges(g, ["CO_OCCURS_WITH"], 3).count() == 1 and analytics.preset(g, "structure").edges.count() == 5
    assert analytics.display(g, 4).edges.count() == 3 and [r.id for r in analytics.connections(g, "currents").collect()] == ["w2", "m1", "m5", "w1"]
    assert [r.id for r in analytics.page(analytics.connections(g, "currents"), 1, 3).collect()] == ["w1"]
    texts = g.spark.createDataFrame([(1, "[node:kelp] not [node:algae] but [node:p3]")], "k int, text string")
    assert [(r.node_id, r.label, r.known) for r in analytics.citations(g, texts).orderBy("position").collect()] == [("kelp", "kelp", True), ("algae", None, False), ("p3", "Flood", True)]
    assert analytics.linked_text("[node:kelp] not [node:algae]", {"kelp": "Kelp"}) == "[Kelp] not [node:algae]"
    assert {r.id for r in analytics.matching_text(g, "pilots").collect()} == {"p2", "p3", "pilots"}


def test_tools(papers):
    import json

    own = tools.GraphTools(papers)
    schema = json.loads(own.get_graph_schema())
    assert schema["node_types"]["Passage"] == {"count": 3, "properties": ["text"]} and {d["n"] for d in schema["directions"]} == {1, 2, 3, 5}
    assert json.loads(own.run_graph_query("MATCH (s:Section) RETURN s.id"))["rows"] == [["intro"], ["tides"]]
    assert json.loads(own.run_graph_query("RETURN tide"))["error"]["line"] == 1
    assert json.loads(own.read_graph_node("p2"))["properties"]["text"].startswith("Spring") and "error" in json.loads(own.read_graph_node("algae"))
    own.left = 0
    with pytest.raises(Exception):
        own.read_graph_node("p2")
    assert tools.preview({"a": "x" * 700, "b": list(range(20))})["a"].endswith("…")


def test_folding_is_pythons(spark):
    """Each letter by itself, as Python folds it."""
    rows = [(chr(k),) for k in range(0x110000) if not 0xD800 <= k < 0xE000 and (chr(k).casefold() != chr(k) or k % 97 == 0)] + [("Straße ΜΆΪΟΣ İz ﬁne",), ("",), (None,)]
    found = spark.createDataFrame(rows, "c string").select("c", extraction.folded(F.col("c")).alias("f")).collect()
    assert [r for r in found if (None if r.c is None else r.c.casefold()) != r.f] == [] and len(found) > 12_000


def test_saving_is_all_or_nothing(spark, graph, tmp_path):
    broken = type(graph)(graph.nodes, graph.edges.withColumn("target", F.when(F.col("id") == "r2", "nowhere").otherwise(F.col("target"))))
    with pytest.raises(ValueError, match="r2"):
        graph_json.save(broken, str(tmp_path / "g"))
    assert list(tmp_path.iterdir()) == []
    graph_json.save(graph, str(tmp_path / "g"))
    with pytest.raises(ValueError, match="already"):
        graph_json.save(graph, str(tmp_path / "g"))
    assert [p.name for p in tmp_path.iterdir()] == ["g"] and sorted(p.name for p in (tmp_path / "g").iterdir()) == ["edges", "nodes"]


def between_joins(plan, scanned):
    """What stands over each scan of a table up to the join that it enters."""
    lines, out = plan.split("\n"), []
    depth = lambda x: re.match(r"[ :]*([+:]- )?", x).end()
    for k, line in enumerate(lines):
        if scanned in line and "FileScan" in line:
            at, over = depth(line), []
            for up in reversed(lines[:k]):
                if depth(up) < at:
                    at = depth(up)
                    if "Join" in up:
                        break
                    over.append(up.strip(" :+-*()0123456789").split(" ")[0])
            out.append(over)
    return out


def test_stored_edges_dont_move(spark, graph, tmp_path):
    graph_json.save_tables(graph, "ports_and_ships", 4, f"file://{tmp_path}")
    stored = graph_json.load_tables(spark, "ports_and_ships")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for text in ("MATCH (a:Port)-[:ROUTE]->(b)-[:ROUTE]->(c)-[:ROUTE]->(a) RETURN a.id AS a, c.id AS c", "MATCH (c:Cargo)<-[:LOADS]-(s)-[k:CALLS]->(p:Port) RETURN c.id AS a, p.id AS c"):
            frame = GraphEngine(stored).query(text)
            assert sorted(map(tuple, frame.collect())) == sorted(map(tuple, GraphEngine(graph).query(text).collect()))
            moved = between_joins(frame._jdf.queryExecution().executedPlan().toString(), "ports_and_ships_edges_")
            assert len(moved) > 1 and not any("Exchange" in over for over in moved)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
        for part in ("nodes", "edges_out", "edges_in"):
            spark.sql(f"drop table ports_and_ships_{part}")


def test_stored_edges_move_by_type(spark, graph, tmp_path, monkeypatch):
    """What moved for one type is dropped before the next is written; types that the graph's maker left out of between are stored too."""
    there = []
    for name, between, seen in (("typed", {}, [0, 1, 2, 3, 4, 5, 6, 7, 8]), ("known", {"ROUTE": (("Port",), ("Port",))}, [0, 1, 4, 5, 8])):
        folder = tmp_path / name
        there.clear()
        monkeypatch.setattr(graph_json, "tidy", lambda spark, at=folder: there.append(len(list(at.glob("edges_*/type=*")))), raising=False)
        graph_json.save_tables(replace(graph, between=between), name, 4, str(folder))
        assert there == seen
        stored = graph_json.load_tables(spark, name)
        for table in (stored.edges, stored.by_target):
            assert sorted(map(repr, table.select(*graph.edges.columns).collect())) == sorted(map(repr, graph.edges.collect()))
        assert sorted(map(repr, stored.nodes.select(*graph.nodes.columns).collect())) == sorted(map(repr, graph.nodes.collect()))
        for part in ("nodes", "edges_out", "edges_in"):
            spark.sql(f"drop table {name}_{part}")


def plain_path(edges, start, goal):
    """By a search from the start alone: of the shortest paths that whose edges come first."""
    before, level = {start: None}, [start]
    while level and goal not in before:
        found = []
        for near in level:
            for _, a, b in edges:
                for x, y in ((a, b), (b, a)):
                    if x == near and y not in before:
                        before[y] = near
                        found.append(y)
        level = found
    path = [goal] if goal in before else []
    while path and path[-1] != start:
        path.append(before[path[-1]])
    return path[::-1]


def test_paths_from_both_ends(spark):
    rng = random.Random(11)
    names = [f"n{k}" for k in range(40)]
    edges = [(f"e{k}", *rng.sample(names, 2)) for k in range(55)]
    own = make_graph(spark, [(n, n, "T", {}) for n in names], [(i, a, b, "X", {}) for i, a, b in edges])
    asked = [tuple(rng.sample(names, 2)) for _ in range(5)] + [("n1", "n1"), ("n1", "nowhere")]
    found = [analytics.shortest_path(own, a, b) for a, b in asked]
    assert found == [plain_path(edges, a, b) if b in names else [] for a, b in asked] and max(map(len, found)) > 3


def test_clusters_of_a_deep_tree(spark, monkeypatch):
    """A thousand passages in one another under nested headings take some ten rounds."""
    nodes = [("d", "d", "Document", {}), ("s1", "s1", "Section", {}), ("s2", "s2", "Section", {}), ("lost", "lost", "Passage", {}), ("x", "x", "Passage", {}), ("y", "y", "Passage", {})] + [(f"p{k}", "p", "Passage", {}) for k in range(1000)]
    edges = [("a", "d", "s1", "CONTAINS", {}), ("b", "s1", "s2", "CONTAINS", {}), ("c", "s2", "p0", "CONTAINS", {}), ("l", "d", "lost", "CONTAINS", {}), ("xy", "x", "y", "CONTAINS", {}), ("yx", "y", "x", "CONTAINS", {})] + [(f"e{k}", f"p{k - 1}", f"p{k}", "CONTAINS", {}) for k in range(1, 1000)]
    rounds = []
    plain = analytics.kept
    monkeypatch.setattr(analytics, "kept", lambda frame: rounds.append(1) or plain(frame))
    monkeypatch.setattr(analytics, "MOST_DOUBLINGS", 14)
    found = {r.id: r.cluster for r in analytics.clusters(make_graph(spark, nodes, edges, "text string", "weight bigint")).collect()}
    assert found == {"d": None, "lost": None, "x": None, "y": None, "s1": "s1", "s2": "s2"} | {f"p{k}": "s2" for k in range(1000)} and len(rounds) <= 15


def test_evidence_as_a_table(spark):
    blocks = extraction.placed(extraction.passages_of(spark.createDataFrame([(1, "harbour pilots meet\npilots steer harbour boats\nboats"), (2, "pilots of the harbour")], "doc_id bigint, text string")))
    _, found = extraction.mentioned(blocks)
    lists = extraction.build_graph(blocks.drop("document_id", "node_id", "type", "parent"))
    table = extraction.evidence_of(found)
    for link in lists.edges.where("type = 'CO_OCCURS_WITH'").collect():
        assert [r.id for r in analytics.evidence(lists, link.id, table).collect()] == link.properties.evidence and len(link.properties.evidence) == link.properties.weight


def test_docx_by_format(spark, tmp_path, monkeypatch):
    """Files written and read by the data source; what XML can't hold goes, and read_docx finds the same."""
    spark.dataSource.register(docx.DocxSource)
    texts = {"a": [("Title & <co>", 1), ("one\ttwo  three", None), ("bell\x07 and Ünïcödé \U0001f600", None), ("Under", 3)], "b.c": [("x " * 3000, None)], "Überschrift 1": [("only", None)]}
    rows = [(f"{name}.docx", [{"text": t, "level": level} for t, level in own]) for name, own in texts.items()]
    frame = spark.createDataFrame(rows, docx.DOCUMENT).repartition(2)
    folder = f"{tmp_path}/out"
    frame.write.format("docx").mode("append").save(folder)
    frame.write.format("docx").mode("append").save(folder)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted([f"{n}.docx" for n in texts] + ["_SUCCESS"])
    want = sorted((f"{name}.docx", k, " ".join(t.replace("\x07", "").split()), level) for name, own in texts.items() for k, (t, level) in enumerate(own, 1))
    for path in (folder, f"file://{folder}"):
        found = spark.read.format("docx").load(path)
        assert sorted((r.filename, r.position, r.text, r.level) for r in found.collect()) == want
    assert sorted(map(repr, found.collect())) == sorted(map(repr, docx.read_docx(spark, folder).collect()))
    assert [r.text for r in spark.read.format("docx").load(f"{folder}/b.c.docx").collect()] == [" ".join(["x"] * 3000)]
    monkeypatch.setattr(docx, "TASK_BYTES", 1)
    assert [len(p.paths) for p in docx.DocxReader({"path": folder}).partitions()] == [1, 1, 1]
    (tmp_path / "out" / "bad.docx").write_bytes(b"no archive")
    with pytest.raises(Exception, match="can't be read"):
        spark.read.format("docx").load(folder).collect()


def test_docx_in_folders(spark, tmp_path):
    spark.dataSource.register(docx.DocxSource)
    frame = spark.createDataFrame([(f"{k % 2}/{k}.docx", [{"text": f"line {k}", "level": None}]) for k in range(4)], docx.DOCUMENT)
    frame.write.format("docx").mode("append").save(f"{tmp_path}/out")
    for found in (spark.read.format("docx").load(f"{tmp_path}/out"), docx.read_docx(spark, f"{tmp_path}/out")):
        assert sorted((r.filename, r.text) for r in found.collect()) == [(f"{k}.docx", f"line {k}") for k in range(4)]
    assert sorted(p.name for p in (tmp_path / "out" / "1").iterdir()) == ["1.docx", "3.docx"]


def test_tools_answer_in_whole_json(papers, monkeypatch):
    """What is too long loses whole entries, and says so."""
    monkeypatch.setattr(tools, "SCHEMA_CHARACTERS", 300)
    monkeypatch.setattr(tools, "SHOWN_CHARACTERS", 260)
    own = tools.GraphTools(papers)
    schema = own.get_graph_schema()
    assert len(schema) <= 300 and json.loads(schema)["truncated"] and json.loads(schema)["node_types"]
    found = own.run_graph_query("MATCH (n)-[e]-(m) RETURN n, m.label ORDER BY n.id, m.id")
    assert len(found) <= 260 and json.loads(found)["truncated"] and json.loads(found)["columns"] == ["n", "m.label"]
    assert json.loads(tools.text_within({"a": "x" * 50}, 20, ("b",))) == {"truncated": True}


def test_words_are_no_rows(spark):
    """Each text moves once, and nothing of its words is moved, joined or ranked across rows; equal lines, documents and a document without words."""
    texts = ["pilots of PILOTS harbour\nBuoy tide Tide\nbuoy", "the and", "", "neap NeaP neap\nNeaP neap", "pilots of PILOTS harbour\nBuoy tide Tide\nbuoy"]
    counts = extraction.term_counts(extraction.placed(extraction.passages_of(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))))
    found = extraction.found_in(counts)
    for frame in (extraction.scored(counts), extraction.mentions(counts), extraction.co_occurrences(found)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Window" not in plan and "ExistingRDD" not in plan.replace("Scan ExistingRDD[doc_id", "")
    assert sorted((r.term, r.total, r.df, r.n, r.label) for r in extraction.scored(counts).collect()) == [("buoy", 2, 2, 3, "buoy"), ("harbour", 1, 1, 3, "harbour"), ("neap", 5, 2, 2, "NeaP"), ("pilots", 2, 1, 3, "pilots"), ("tide", 2, 1, 3, "tide")]
    assert sorted((r.position, r.term, r.tf) for r in extraction.mentions(counts).collect()) == [(1, "harbour", 1), (1, "neap", 3), (1, "pilots", 2), (2, "buoy", 1), (2, "neap", 2), (2, "tide", 2), (3, "buoy", 1)]
    assert sorted((r.one, r.two, r.weight) for r in extraction.co_occurrences(found).collect()) == [("buoy", "tide", 1), ("harbour", "pilots", 1)]
    assert {(r.position, r.term) for r in extraction.mentions(counts, per_passage=1).collect()} == {(1, "pilots"), (1, "neap"), (2, "tide"), (2, "neap"), (3, "buoy")}


def test_exported_entities_are_read_by_their_types_or_hashes(spark, graph, tmp_path):
    engine = GraphEngine(graph)

    def made(text):
        result = engine.compiled(*engine.checked(text, None), False, False)
        plan = results.hydrated(result, graph)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("= Ship"), plan.count("= CALLS"), plan.count("LeftSemi")

    assert made("MATCH (s:Ship)-[c:CALLS]->(p:Port) RETURN s, c") == (2, 2, 0)
    assert made("MATCH (s:Ship) WITH s AS t RETURN t") == (2, 0, 0)
    assert made("MATCH (s)-[c]->(p) RETURN s")[2] == 1
    assert made("MATCH w = (s:Ship)-[es*1..2]->(p) RETURN w, es")[2] == 2
    engine.export("MATCH w = (s:Ship)-[es*1..2]->(p:Port) OPTIONAL MATCH (s)-[l:LOADS]->(g:Cargo) RETURN s, p, w, es, l, g, nodes(w) AS ns", str(tmp_path / "rows"))
    rows = [json.loads(line) for f in (tmp_path / "rows").glob("part-*") for line in f.read_text().splitlines()]
    assert len(rows) == len(engine.query("MATCH w = (s:Ship)-[es*1..2]->(p:Port) OPTIONAL MATCH (s)-[l:LOADS]->(g:Cargo) RETURN s, p, w, es, l, g").collect()) > 4
    ids = {r.id for r in graph.nodes.collect()}
    for r in rows:
        assert r["w"]["nodes"] == r["ns"] and r["w"]["relationships"] == r["es"] and r["ns"][0] == r["s"] and r["ns"][-1] == r["p"]
        assert [e["source"] for e in r["es"]] == [n["id"] for n in r["ns"][:-1]] and {n["id"] for n in r["ns"]} <= ids
        assert (r["l"] is None) == (r["g"] is None) and (r["g"] is None or r["l"]["target"] == r["g"]["id"])


@pytest.mark.parametrize("hashes", [1, 3, 1 << 21])
def test_only_repeated_texts_are_moved(spark, monkeypatch, hashes):
    monkeypatch.setattr(extraction, "HASHES", hashes)
    rows = [(5, "one\n\n two "), (2, "one\n\n two "), (9, "three"), (1, None), (4, " \n"), (3, ""), (7, "Übung\tmacht"), (8, "three"), (8, "three"), (6, "\t")]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = extraction.gathered_of(documents)
    got = {r.filename: [(b.position, b.text, b.kind, b.level) for b in r.blocks] for r in found.collect()}
    line = lambda k, text: (k, text, "paragraph", None)
    assert got == {"2": [line(1, "one"), line(2, "two")], "8": [line(1, "three")], "7": [line(1, "Übung\tmacht")], "6": [line(1, "\t")]} and found.count() == 4
    digests = {r.digest for r in documents.where("trim(translate(text, '\n', '')) <> ''").select(F.sha2("text", 256).alias("digest")).collect()}
    assert digests == {r.digest for r in found.collect()} == {r.digest for r in extraction.passages_of(documents).collect()}
    # a text meets an exchange by its digest only where it is repeated
    text = extraction.texts_of(documents)
    assert text._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [digest") == 1 and "LeftAnti" in text._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_documents_give_the_graph_of_their_blocks(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet").where("doc_id % 4 = 0")
    one, two = (extraction.build_graph(f(documents), most_blocks=None, lists=False) for f in (extraction.gathered_of, extraction.passages_of))
    for a, b in ((one.nodes, two.nodes), (one.edges, two.edges)):
        assert a.count() == b.count() > 0 and a.exceptAll(b).isEmpty()
    with pytest.raises(ValueError):
        extraction.build_graph(extraction.gathered_of(documents), most_blocks=1)


def test_a_graph_without_texts_reads_them_only_where_they_are_asked_for(spark, data):
    documents = extraction.gathered_of(spark.read.parquet(f"{data}/documents.parquet").where("doc_id % 4 = 0"))
    one, two = (extraction.build_graph(documents, most_blocks=None, lists=False, texts=t) for t in (True, False))
    for a, b in ((one.nodes, two.nodes), (one.edges, two.edges)):
        assert a.count() == b.count() > 0 and a.exceptAll(b).isEmpty()
    # what is written has no texts, and nothing joins them to what doesn't ask
    assert "text" not in extraction.extracted(documents, most_blocks=None, texts=False).schema["blocks"].dataType.elementType.names
    for frame in (analytics.type_distribution(two), analytics.heaviest(two), two.nodes.select("id", "type")):
        assert "Join" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_a_preset_of_all_nodes_joins_no_edges(graph):
    plan = analytics.preset(graph, "overview").edges._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and analytics.preset(graph, "overview").edges.count() == graph.edges.count()


def test_presets_of_document_graphs_join_no_edges_whose_ends_are_known(spark, data):
    documents = extraction.gathered_of(spark.read.parquet(f"{data}/documents.parquet").where("doc_id % 4 = 0"))
    graph = extraction.build_graph(documents, most_blocks=None, lists=False, texts=False)
    for name in ("concepts", "structure"):
        view, joined = analytics.preset(graph, name), analytics.preset(replace(graph, between={}), name)
        assert "LeftSemi" in joined.edges._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" not in view.edges._jdf.queryExecution().optimizedPlan().toString()
        assert view.edges.count() == joined.edges.count() > 0 and view.edges.exceptAll(joined.edges).isEmpty()
    # an edge that may lead to a node of another type still meets its ends
    assert analytics.preset(replace(graph, between={"CONTAINS": (("Document",), ("Concept",))}), "structure").edges.count() == view.edges.count()
