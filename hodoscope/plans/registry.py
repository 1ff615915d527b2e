"""Registries of transforms, converters and analyses; user code adds to them by decorator."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Registry:
    """Named entries; an unknown name is an error that lists the known ones. Aliases match in any case."""

    def __init__(self, what: str):
        self.what, self._own, self._alias = what, {}, {}

    def register(self, name: str, *aliases: str) -> Callable[[Any], Any]:
        def add(item: Any) -> Any:
            if name in self._own:
                raise ValueError(f"{self.what} {name} is registered twice")
            self._own[name] = item
            for alias in (name, *aliases):
                self._alias[alias.lower()] = name
            return item

        return add

    def get(self, name: str) -> Any:
        known = self._alias.get(name.lower())
        if known is None:
            raise KeyError(f"unknown {self.what} {name}; known: {', '.join(sorted(self._own))}")
        return self._own[known]

    def names(self) -> list[str]:
        return sorted(self._own)


#: A user's analysis takes (tables, script): the run's tables by name and its entry in the configuration; it returns tables by
#: name. A user's converter takes (spark, base, run_id, conversion) and returns (events, channels, schema version).
ALGORITHMS, ANALYSES, CONVERTERS = Registry("algorithm"), Registry("analysis"), Registry("converter")
#: The transforms a detector uses unless its configuration names others.
DEFAULT_CHAIN = ("HitProcessor", "ClusterBuilder", "ClusterReconstructor")
