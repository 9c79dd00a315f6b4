"""All registered queries and the SQL that must give the same rows."""

import importlib
import pkgutil

from . import plans
from .registry import COVERS, ORACLES, QUERIES

for _found in pkgutil.iter_modules(plans.__path__):
    importlib.import_module(f"{plans.__name__}.{_found.name}")

__all__ = ["COVERS", "ORACLES", "QUERIES"]
