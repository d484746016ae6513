"""Loads every module of the subpackage that registers a query."""

from importlib import import_module

from tidewatch.llm.common import ORACLES, QUERIES

MODULES = [
    "exact_dedup", "importance", "line_dedup", "ngram_join", "packing", "permutation_index", "pii", "quality",
    "quality_rules", "sharding", "tokens", "toxicity", "vector_codes",
]

for _name in MODULES:
    import_module(f"tidewatch.llm.{_name}")

__all__ = ["ORACLES", "QUERIES"]
