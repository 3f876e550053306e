"""Errors of graph queries, with the place in the query text where there is one."""

from __future__ import annotations


class QueryError(ValueError):
    """A query that can't be read, checked or evaluated. position counts code points from 0."""

    code = "QUERY_ERROR"

    def __init__(self, message: str, position: int | None = None):
        super().__init__(message)
        self.position = position

    def details(self, text: str) -> dict:
        """message and code, and position, line and column (from 1) if known."""
        out: dict = {"message": str(self), "code": self.code}
        if self.position is not None:
            lines = text[: self.position].split("\n")
            out |= {"position": self.position, "line": len(lines), "column": len(lines[-1]) + 1}
        return out


class QueryLimitError(QueryError):
    """A query beyond a fixed limit."""

    code = "QUERY_LIMIT"
