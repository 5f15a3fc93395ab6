"""Registered jobs. Importing the package registers all of them."""

import importlib
import pkgutil

from .registry import CHECKS, JOBS

for _m in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("jobs_")):
    importlib.import_module(f"{__name__}.{_m}")

__all__ = ["CHECKS", "JOBS"]
