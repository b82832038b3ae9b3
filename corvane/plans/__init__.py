"""Modules of registered queries, one for each family of operators."""

from importlib import import_module

FAMILIES: tuple[str, ...] = ("sparse", "ranking", "upkeep", "text", "evaluation", "graph", "structure", "structured", "sources", "service")


def load() -> None:
    for family in FAMILIES:
        import_module(f"{__name__}.{family}")
