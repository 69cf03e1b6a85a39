"""Where queries and their oracles are registered."""

from __future__ import annotations

from ..sources.adapter import SQL

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, prelude: str | bool = True):
    """Registers a function (spark, sf_dir) under its name, and its oracle.

    The oracle may use the adapter's views, and those of a further prelude if one is given as text; with False it
    stands alone."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            views = SQL + (f",{prelude}" if isinstance(prelude, str) else "")
            more = ", " if oracle.startswith("q AS") else " "
            ORACLES[f.__name__] = f"WITH {views}{more}{oracle}" if prelude else oracle
        return f

    return add
