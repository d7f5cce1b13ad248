"""All registered queries."""
import importlib

from veracell.plans.registry import ORACLES, QUERIES

for _part in ("profile", "semantics", "duplicates", "features", "detect", "score", "explain",
              "clean"):
    try:
        importlib.import_module(f"veracell.plans.catalog_{_part}")
    except ModuleNotFoundError as e:
        if f"catalog_{_part}" not in str(e):
            raise

__all__ = ["ORACLES", "QUERIES"]
