"""Reuse of composed expressions.

Every node of a Column costs a round trip to the JVM. The conversion expressions
have thousands of nodes and depend on settings only, so each is composed once per
Spark application and setting.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import TypeVar

from pyspark import SparkContext

R = TypeVar("R")


def per_application(fn: Callable[..., R]) -> Callable[..., R]:
    """Cache ``fn`` by its (hashable) arguments while the application lives."""
    kept: dict = {}

    @functools.wraps(fn)
    def cached(*args, **kwargs) -> R:
        app = SparkContext.getOrCreate().applicationId
        if kept.get("app") != app:
            kept.clear()
            kept["app"] = app
        key = (args, tuple(sorted(kwargs.items())))
        if key not in kept:
            kept[key] = fn(*args, **kwargs)
        return kept[key]

    return cached
