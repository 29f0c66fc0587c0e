"""Reuse of large column expressions.

Columns are unresolved expressions, so one that depends on names only can serve many plans. Building the rule
expressions takes thousands of calls into the JVM; they are built once per JVM connection.
"""

from __future__ import annotations

from functools import lru_cache, wraps

from pyspark import SparkContext


def built_once(build):
    @lru_cache(maxsize=4096)
    def keep(_gateway, *args):
        return build(*args)

    @wraps(build)
    def get(*args):
        return keep(SparkContext._gateway, *args)

    return get
