"""Queries over a graph: as DataFrames, or as a bounded result with the entities that support it."""

from __future__ import annotations

import json
import threading
import time
import uuid
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import QueryError, QueryLimitError
from .functions.typed import EDGE, NODE, PATH, Kind, from_spark
from .graph import ORD, PROPERTIES, PropertyGraph
from .plans.analysis import Scoped, analyse, expressions
from .plans.compiler import ORDER, SEEN_EDGES, SEEN_NODES, Compiler, Result
from .plans.parser import MOST_HOPS, parse
from .plans.syntax import Call, Match, Projection
from .sources.results import export

#: Fixed value: characters of parameters as JSON.
MOST_PARAMETERS = 64_000


@dataclass(frozen=True)
class QueryLimits:
    """Of execute, whose results are small. query has none of these limits but max_hops.

    More rows than max_intermediate_rows after a clause, or than max_steps after all scans, joins and clauses
    together, are an error. The job that computes the result counts them, and each scan or join stops at one row
    more than max_steps, whatever WHERE would leave of its rows. max_intermediate_rows None: nothing is counted or
    stopped, and WHERE may filter before the joins. A job alone may take a second, so the time allowed is longer
    than an engine in memory would allow.
    """

    max_hops: int = MOST_HOPS
    max_rows: int = 1000
    max_result_bytes: int = 4 * 1024 * 1024
    max_intermediate_rows: int | None = 20_000
    max_steps: int = 250_000
    timeout_seconds: float | None = 120.0


class GraphEngine:
    """Reads a property graph by statements of the query language."""

    #: Fixed value: the language's name in results.
    language = "GraphQuery/1"

    def __init__(self, graph: PropertyGraph, limits: QueryLimits | None = None):
        self.graph, self.limits = graph, limits or QueryLimits()

    def checked(self, text: str, parameters: dict | None) -> tuple[list[Scoped], dict]:
        parameters = {} if parameters is None else parameters
        if not isinstance(parameters, dict) or not all(isinstance(k, str) for k in parameters):
            raise QueryError("Parameters are an object with string keys.")
        try:
            encoded = json.dumps(parameters, allow_nan=False)
        except (TypeError, ValueError) as e:
            raise QueryError("Parameters are finite JSON values.") from e
        except RecursionError as e:
            raise QueryLimitError("Parameters are nested too deep.") from e
        if len(encoded) > MOST_PARAMETERS:
            raise QueryLimitError(f"Parameters may have {MOST_PARAMETERS:,} characters.")
        return analyse(parse(text, self.limits.max_hops)), parameters

    def query(self, text: str, parameters: dict | None = None) -> DataFrame:
        """The result as a DataFrame with the statement's columns; a node or edge is its id, a path a struct of ids.

        Rows have an order only with ORDER BY. Errors of rows are raised by the job that computes them.
        """
        clauses, parameters = self.checked(text, parameters)
        return self.compiled(clauses, parameters, self.order_matters(clauses), False).named()

    def export(self, text: str, folder: str, parameters: dict | None = None) -> None:
        """The result as JSON lines in a new folder, nodes, edges and paths as objects; it may be of any size."""
        clauses, parameters = self.checked(text, parameters)
        export(self.compiled(clauses, parameters, self.order_matters(clauses), False), self.graph, folder)

    def compiled(self, clauses: list[Scoped], parameters: dict, order: bool, provenance: bool, most: tuple[int, int] | None = None) -> Result:
        return Compiler(self.graph, parameters, order, provenance, most).compile(clauses)

    @staticmethod
    def order_matters(clauses: list[Scoped]) -> bool:
        """Whether results depend on the order of rows: collected lists, pages that sorting doesn't settle, optional matches that are keyed by it."""
        known: set[str] = set()
        for scoped in clauses:
            clause = scoped.clause
            if any(isinstance(p, Call) and p.name == "collect" for e in expressions(clause) for p in e.all()):
                return True
            if isinstance(clause, Projection) and (clause.skip or clause.limit):
                return True
            if isinstance(clause, Match) and clause.optional:
                named = Compiler.mentioned(None, clause)
                if len({n for n in named if n in scoped.before}) > 1 or any(scoped.before.get(n, "node") != "node" for n in named):
                    return True
            known |= set(scoped.after)
        return False

    def execute(self, text: str, parameters: dict | None = None) -> dict:
        """columns, rows (JSON values, in the language's order), the supporting graph's ids, truncated and stats."""
        started = time.monotonic()
        try:
            clauses, parameters = self.checked(text, parameters)
            most = self.limits.max_intermediate_rows
            limits = None if most is None else (self.limits.max_steps, most)
            result = self.within_time(lambda: self.compiled(clauses, parameters, True, True, limits))
            rows, total, made = self.within_time(lambda: self.collected(result))
            return self.envelope(result, rows, total, made, started)
        except RecursionError as e:
            raise QueryLimitError("The query or its data are nested too deep.") from e
        except PySparkException as e:
            found = from_spark(e)
            if found is None:
                raise
            raise found from e

    def collected(self, result: Result) -> tuple[list, int, dict[bool, list[int]]]:
        """The rows to return and one more at most, how many there are, and the rows counted after joins (False) and clauses (True)."""
        most, keep = self.limits.max_intermediate_rows, self.limits.max_rows
        if most is None:
            rows = result.frame.limit(keep + 1).collect()
            return rows[:keep], len(rows) if len(rows) <= keep else result.frame.count(), {}
        frame = result.frame.limit(most + 1)
        rows = frame.collect()
        metrics = frame._jdf.queryExecution().observedMetrics()
        made: dict[bool, list[int]] = {False: [], True: [len(rows)]}
        for name, after_clause in result.counted.items():
            # what the optimizer leaves out has no rows
            found = metrics.get(name)
            made[after_clause].append(found.get().getLong(0) if found.isDefined() else 0)
        if max(made[True]) > most:
            raise QueryLimitError("A clause makes too many rows; filter earlier.")
        if sum(made[True]) + sum(made[False]) > self.limits.max_steps:
            raise QueryLimitError("The query makes too many rows in all; filter earlier.")
        return rows[:keep], len(rows), made

    def within_time(self, job):
        if self.limits.timeout_seconds is None:
            return job()
        context, tag, late = self.graph.spark.sparkContext, f"quiverql-{uuid.uuid4().hex}", threading.Event()
        timer = threading.Timer(self.limits.timeout_seconds, lambda: (late.set(), context.cancelJobsWithTag(tag)))
        context.addJobTag(tag)
        timer.start()
        try:
            return job()
        except Exception as e:
            if late.is_set():
                raise QueryLimitError("The query took too long.") from e
            raise
        finally:
            timer.cancel()
            context.removeJobTag(tag)

    def envelope(self, result: Result, rows: list, total: int, made: dict[bool, list[int]], started: float) -> dict:
        ids = {NODE: set(), EDGE: set()}
        for row in rows:
            for k, (_, kind) in enumerate(result.columns):
                entities(row[f"c{k}"], kind, ids)
        known = {kind: self.looked_up(kind, wanted) for kind, wanted in ids.items()}
        out, size, nodes, edges = [], 0, set(), set()
        for row in rows:
            values = [plain(row[f"c{k}"], kind, known) for k, (_, kind) in enumerate(result.columns)]
            size += len(json.dumps(values, ensure_ascii=False, allow_nan=False).encode())
            if size > self.limits.max_result_bytes:
                if not out:
                    raise QueryLimitError("A row is larger than a result may be; return properties instead of entities.")
                break
            out.append(values)
            nodes.update(row[SEEN_NODES])
            edges.update(row[SEEN_EDGES])
        stats = {"rows": len(out), "total_rows": total, "elapsed_ms": round(1000 * (time.monotonic() - started), 2)}
        if made:
            stats |= {"work": sum(made[True]) + sum(made[False]), "peak_intermediate_rows": max(made[True])}
        return {"language": self.language, "columns": [n for n, _ in result.columns], "rows": out, "graph": {"node_ids": sorted(nodes), "edge_ids": sorted(edges)}, "truncated": len(out) < total, "stats": stats}

    def looked_up(self, kind: Kind, ids: set[str]) -> dict[str, dict]:
        """The entities with those ids, as the graph has them; at most as many as the rows returned name."""
        if not ids:
            return {}
        table = self.graph.nodes if kind is NODE else self.graph.edges
        found = {}
        for row in table.where(F.col("id").isin(*ids)).collect():
            one = {k: json_value(v) for k, v in row.asDict().items() if k != ORD and v is not None}
            if isinstance(one.get(PROPERTIES), dict):
                one[PROPERTIES] = {k: v for k, v in one[PROPERTIES].items() if v is not None}
            found[one["id"]] = one | {"$type": "node" if kind is NODE else "relationship"}
        return found


def entities(value: object, kind: Kind, ids: dict[Kind, set[str]]) -> None:
    """Adds the ids of all entities in a value."""
    if value is None:
        return
    if kind in (NODE, EDGE):
        ids[kind].add(value)
    elif kind is PATH:
        ids[NODE].update(value["nodes"])
        ids[EDGE].update(value["edges"])
    elif kind.name == "list":
        for item in value:
            entities(item, kind.item, ids)
    elif kind.name == "map" and kind.fields:
        for key, own in kind.fields:
            entities(value[key], own, ids)


def plain(value: object, kind: Kind, known: dict[Kind, dict[str, dict]]) -> object:
    """A value as JSON."""
    if value is None:
        return None
    if kind in (NODE, EDGE):
        return known[kind].get(value, {"id": value})
    if kind is PATH:
        return {"$type": "path", "nodes": [plain(v, NODE, known) for v in value["nodes"]], "relationships": [plain(v, EDGE, known) for v in value["edges"]]}
    if kind.name == "list":
        return [plain(v, kind.item, known) for v in value]
    if kind.name == "map" and kind.fields:
        return {key: plain(value[key], own, known) for key, own in kind.fields}
    return json_value(value)


def json_value(value: object) -> object:
    if hasattr(value, "toPython"):
        value = value.toPython()
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {k: json_value(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [json_value(v) for v in value]
    if isinstance(value, (bool, int, float, str)) or value is None:
        return value
    from decimal import Decimal

    return float(value) if isinstance(value, Decimal) else str(value)
