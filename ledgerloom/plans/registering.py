"""How a module of queries lists them."""

from __future__ import annotations


def registry():
    """(queries, oracles, decorator): the decorator lists a function under its name, with its DuckDB SQL if there is any."""
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(function):
            queries[function.__name__] = function
            if sql:
                oracles[function.__name__] = sql
            return function

        return add

    return queries, oracles, query
