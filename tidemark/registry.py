"""Named queries over the fixture tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "q01_flow_by_year"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


_LATER: dict[str, Callable[[], str]] = {}


def query(oracle: str | Callable[[], str] | None = None):
    """Registers a function of (spark, sf_dir) under its own name. A twin that is made of texts further down in its module is given as a function."""

    def add(f):
        QUERIES[f.__name__] = f
        if callable(oracle):
            _LATER[f.__name__] = oracle
        elif oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def load_all() -> None:
    from tidemark.plans import analytics, composite, performance, probes, quality, scalars  # noqa: F401

    ORACLES.update({name: make() for name, make in _LATER.items()})


load_all()
