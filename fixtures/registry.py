"""Registered queries: a Spark callable each, and the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add
