"""Property graphs as DataFrames: a pattern language, extraction from documents, and graph analytics."""

from .engine import GraphEngine, QueryLimits
from .errors import QueryError, QueryLimitError
from .graph import PropertyGraph

__all__ = ["GraphEngine", "PropertyGraph", "QueryError", "QueryLimitError", "QueryLimits"]
