"""Every registered query over the driver's tables; importing the modules registers them."""

import importlib
import pkgutil

from .registry import ORACLES, QUERIES

for _m in pkgutil.iter_modules(__path__):
    if _m.name != "registry":
        importlib.import_module(f"{__name__}.{_m.name}")

__all__ = ["ORACLES", "QUERIES"]
