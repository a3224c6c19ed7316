"""A register of queries with the SQL that checks them, written next to each other."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps


class Book:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, days: Sequence[str] = ()) -> Callable:
        """Register a query by its name. days: date columns, which go out as ISO text so that every client shows them alike."""

        def add(f: Callable) -> Callable:
            @wraps(f)
            def run(spark, sf):
                df = f(spark, sf)
                return df.withColumns({d: df[d].cast("string") for d in days}) if days else df

            self.queries[f.__name__] = run
            if sql:
                shown = ", ".join(f"cast({d} as varchar) as {d}" for d in days)
                self.sql[f.__name__] = f"select * replace ({shown}) from ({sql})" if days else sql
            return f

        return add
