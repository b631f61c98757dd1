"""Outputs that are made when they are read.

A transition has several result tables. Numbering ids and writing shared inputs
are jobs, so an output (or an input that several outputs share) is a function
without arguments that runs at most once, when something first reads it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame

once = functools.cache  # a shared input: made by its first reader


class Outputs(Mapping[str, DataFrame]):
    """Result tables by name; reading one makes that one alone."""

    def __init__(self, **makers: Callable[[], DataFrame]):
        self._makers = {name: once(make) for name, make in makers.items()}

    def __getitem__(self, name: str) -> DataFrame:
        return self._makers[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def __or__(self, other: Outputs) -> Outputs:
        """Both sets of outputs; the right one's where a name is in both."""
        return Outputs(**{**self._makers, **other._makers})

    def only(self, *names: str) -> Outputs:
        return Outputs(**{name: self._makers[name] for name in names})
