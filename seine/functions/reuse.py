"""Expressions that are built once. A column expression is no part of any DataFrame; the library's hold thousands of nodes, and each takes a call to the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from typing import TypeVar

from pyspark import SparkContext

T = TypeVar("T")
_MOST = 64


def reused(build: Callable[..., T]) -> Callable[..., T]:
    """What a function of hashable arguments builds, kept for its next call in the same JVM."""
    known: dict[tuple, T] = {}

    @wraps(build)
    def get(*args) -> T:
        key = (id(SparkContext._gateway), args)
        if key not in known:
            if len(known) >= _MOST:
                known.clear()
            known[key] = build(*args)
        return known[key]

    return get
