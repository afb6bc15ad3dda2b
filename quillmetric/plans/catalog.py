"""All registered queries; importing a module registers its entries."""

import importlib

from quillmetric.plans.registry import ORACLES, QUERIES

MODULES = ("post_queries", "lint_queries", "scalar_queries", "store_queries", "rank_queries", "outreach_queries", "source_queries", "eval_queries", "stream_queries")

for _module in MODULES:
    importlib.import_module(f"quillmetric.plans.{_module}")

__all__ = ["ORACLES", "QUERIES"]
