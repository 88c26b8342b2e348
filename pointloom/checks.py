"""Checks of arguments, and memory for what functions of arrays gave."""

from __future__ import annotations

import contextlib
import functools
import inspect
import weakref
from collections import OrderedDict

import numpy as np
from pyspark.sql import DataFrame

_checking = True
_memories: weakref.WeakSet = weakref.WeakSet()


def assert_shape(values, shape: tuple, name: str = "array"):
    """values as an array of that shape, where None stands for any length and a leading ... for any axes; ValueError otherwise."""
    values = np.asarray(values)
    if _checking:
        got, want = values.shape, tuple(shape)
        if want and want[0] is ...:
            want = want[1:]
            got = got[len(got) - len(want) :] if len(got) >= len(want) else got
        if len(got) != len(want) or any(w is not None and g != w for g, w in zip(got, want, strict=True)):
            raise ValueError(f"{name} has shape {values.shape}, not {tuple(shape)}")
    return values


def assert_columns(df: DataFrame, *columns: str) -> DataFrame:
    """df, if it has the columns; ValueError otherwise."""
    missing = [c for c in columns if c not in df.columns]
    if _checking and missing:
        raise ValueError(f"no column {', '.join(missing)} among {', '.join(df.columns)}")
    return df


@contextlib.contextmanager
def no_shape_assertions():
    """Within it, shapes and columns aren't checked."""
    global _checking
    before, _checking = _checking, False
    try:
        yield
    finally:
        _checking = before


def arg_count(f) -> int:
    """How many arguments f takes by place; a large number if any."""
    kinds = [p.kind for p in inspect.signature(f).parameters.values()]
    if inspect.Parameter.VAR_POSITIONAL in kinds:
        return 1 << 30
    return sum(k in (inspect.Parameter.POSITIONAL_ONLY, inspect.Parameter.POSITIONAL_OR_KEYWORD) for k in kinds)


class Memoize:
    """f with its last results kept by the values of its arguments; arrays count by type, shape and bytes."""

    def __init__(self, f, most: int = 128):
        functools.update_wrapper(self, f)
        self.f, self.most, self.kept = f, most, OrderedDict()
        _memories.add(self)

    @staticmethod
    def _key(v):
        return (v.dtype.str, v.shape, v.tobytes()) if isinstance(v, np.ndarray) else v

    def __call__(self, *args):
        key = tuple(map(self._key, args))
        if key not in self.kept:
            self.kept[key] = self.f(*args)
            if len(self.kept) > self.most:
                self.kept.popitem(last=False)
        self.kept.move_to_end(key)
        return self.kept[key]

    def __reduce__(self):
        return Memoize, (self.f, self.most)


def clear_memories() -> None:
    for m in list(_memories):
        m.kept.clear()
