"""Registered queries: a Spark plan and the SQL it must agree with, side by side."""

from importlib import import_module

MODULES = ("functions_q", "corpus_q", "scan_q", "catalog_q", "inventory_q", "dashboard_q", "report_q")


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
