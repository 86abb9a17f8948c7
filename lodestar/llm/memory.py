"""What Python workers remember from task to task, and when they give it back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from functools import lru_cache

_FORGET: list[Callable[[], None]] = []
_SERVED = [""]


def remembered(size: int) -> Callable:
    """lru_cache whose content goes once the worker serves another operator."""

    def put(f: Callable) -> Callable:
        kept = lru_cache(maxsize=size)(f)
        _FORGET.append(kept.cache_clear)
        return kept

    return put


def serve(operator: str) -> None:
    """For the beginning of a task: a worker that served another operator frees what it remembers for that.

    Workers outlive stages, so without this one would hold the tables of every operator of a pipeline.
    """
    if _SERVED[0] != operator:
        for forget in _FORGET:
            forget()
        if _SERVED[0]:
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)
        _SERVED[0] = operator
