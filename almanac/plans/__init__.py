"""All registered queries of the library. They are imported when first asked for: operators use parts of this package."""

from __future__ import annotations

from . import registry

__all__ = ["ORACLE_SQL", "QUERIES"]


def __getattr__(name: str) -> dict:
    if name not in __all__:
        raise AttributeError(name)
    from . import registered  # noqa: F401

    return getattr(registry, name)
