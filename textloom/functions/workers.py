"""Heavy objects of Python workers: built once in each, from a factory, however many tasks and batches it serves."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_HELD: dict[str, Any] = {}


def held(name: str, factory: Callable[[], Any]) -> Any:
    """The worker's object of that name; None where its factory failed, which is not tried again."""
    if name not in _HELD:
        try:
            _HELD[name] = factory()
        except Exception:
            _HELD[name] = None
    return _HELD[name]
