"""Properties of a frame bound to values, columns or rules that read other properties, compiled to columns.

A rule sees a scope: ``scope.name`` is a property or a column of the frame. Properties become columns in the order of their
references, those that need nothing from each other in one step, so each is computed once a frame however many others read it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CircularReference(ValueError):
    pass


class _Scope:
    def __init__(self, read: Callable[[str], Column]):
        self._read = read

    def __getattr__(self, name: str) -> Column:
        return self._read(name)


def bind(frames: DataFrame, props: Mapping[str, object]) -> DataFrame:
    """``frames`` with a column for each of ``props``; a property hides a column of its name only from rules, and then replaces it.

    A rule that comes back to itself raises CircularReference before anything runs, a name that is neither property nor column KeyError.
    """
    made: dict[str, Column] = {}
    step: dict[str, int] = {}
    open_: list[str] = []

    def resolve(name: str) -> None:
        if name in made:
            return
        if name in open_:
            raise CircularReference(" -> ".join([*open_[open_.index(name) :], name]))
        open_.append(name)
        needs = [0]

        def read(other: str) -> Column:
            if other in props:
                resolve(other)
                needs.append(step[other])
            elif other not in frames.columns:
                raise KeyError(other)
            return F.col(f"`{other}`")

        rule = props[name]
        value = rule(_Scope(read)) if callable(rule) and not isinstance(rule, Column) else rule
        made[name] = value if isinstance(value, Column) else F.lit(value)
        step[name] = 1 + max(needs)
        open_.pop()

    for name in props:
        resolve(name)
    for n in sorted(set(step.values())):
        frames = frames.withColumns({k: made[k] for k in made if step[k] == n})
    return frames
