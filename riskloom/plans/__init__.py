"""End-to-end jobs and the registry of named queries (Spark + SQL oracle)."""

from .common import REGISTRY


def load_all() -> dict:
    """Import every query module (registration happens on import)."""
    from . import q_aggregates, flagship  # noqa: F401
    for mod in ("q_clean", "q_joins", "q_windows", "q_ml"):
        try:
            __import__(f"{__name__}.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"{__name__}.{mod}":
                raise
    return REGISTRY
