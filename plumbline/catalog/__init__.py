"""All registered queries; see base.register."""

from importlib import import_module

MODULES = ["text_queries", "graph_queries", "panel_queries", "metric_queries", "check_queries", "link_queries", "source_queries"]


def load_all():
    from plumbline.catalog import base

    for m in MODULES:
        import_module(f"plumbline.catalog.{m}")
    return base.QUERIES, base.ORACLES
