"""Registered queries: a Spark job and, where plain SQL can say the same, a checker text."""

from __future__ import annotations

from collections.abc import Callable

from .views import Feed, duck

JOBS: dict[str, Callable[[Feed], object]] = {}
CHECKS: dict[str, str] = {}


def job(name: str, check: str | None = None, views: str = ""):
    """Register ``fn(feed)``; ``views`` names the feed views the checker text reads."""
    def register(fn):
        if name in JOBS:
            raise ValueError(f"{name} is registered twice")
        JOBS[name] = fn
        if check is not None:
            CHECKS[name] = duck(check, *views.split())
        return fn
    return register
