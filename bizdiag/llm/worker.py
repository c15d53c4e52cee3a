"""Memory that Python workers keep between tasks.

Workers serve one stage after the other. What an operator keeps for its next task (models, caches of
encoded pieces) is of no use to the next operator, so it goes when another one begins.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa

_kept: dict[str, Callable[[], object]] = {}


def keeps(owner: str, clear: Callable[[], object]) -> None:
    """``owner`` keeps something that ``clear`` lets go of; what others keep is let go of now."""
    others = [name for name in _kept if name != owner]
    _kept[owner] = clear
    for name in others:
        _kept.pop(name)()
    if others:
        returned()


def returned() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)
