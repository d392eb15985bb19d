"""The registered queries, one module per family."""

from importlib import import_module

FAMILIES = ["text", "quality", "dedup", "segment", "corpus", "interview", "vectors", "neardup", "bank", "jobs"]


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"{__name__}.{family}")
