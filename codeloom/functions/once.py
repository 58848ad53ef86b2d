"""Reuse of column expressions that do not depend on a DataFrame."""

from __future__ import annotations

import functools
from collections.abc import Callable


def columns_once(build: Callable) -> Callable:
    """Build columns over fixed column names once per Spark gateway.

    A column of a few thousand nodes costs seconds of calls into the JVM; it names its inputs, so
    every DataFrame with those columns can share it.
    """
    built: dict = {}

    @functools.wraps(build)
    def get(*args):
        from pyspark import SparkContext

        gateway = SparkContext._gateway
        if built.get("gateway") is not gateway:
            built.clear()
            built["gateway"] = gateway
        if args not in built:
            built[args] = build(*args)
        return built[args]

    return get
