"""Named queries; `all_queries` loads every module that registers some."""

from importlib import import_module

MODULES = ["reports", "stored_queries", "cleaning_queries", "loading_queries", "series_queries", "narrative_queries"]


def all_queries():
    from tidewatch.plans import registry

    for name in MODULES:
        import_module(f"tidewatch.plans.{name}")
    return registry.QUERIES, registry.ORACLES
