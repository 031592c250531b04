"""Named steps over a DataFrame, in order, open to change: added, removed, replaced, and extended before or after."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

Step = Callable[[DataFrame], DataFrame]


@dataclass
class Steps:
    """Steps run by priority, those of equal priority as they were added. Each is lazy, so a chain is one plan."""

    _steps: dict[str, tuple[int, int, Step]] = field(default_factory=dict)
    _around: dict[str, tuple[list[Step], list[Step]]] = field(default_factory=dict)
    _added: int = 0

    def add(self, name: str, step: Step, priority: int = 50) -> Steps:
        if name in self._steps:
            raise ValueError(f"step {name} is there already; replace it")
        self._steps[name] = (priority, self._added, step)
        self._added += 1
        return self

    def replace(self, name: str, step: Step) -> Steps:
        """In the same place; what was put before and after it stays."""
        priority, at, _ = self._of(name)
        self._steps[name] = (priority, at, step)
        return self

    def remove(self, name: str) -> Steps:
        """With what was put before and after it."""
        self._of(name)
        del self._steps[name]
        self._around.pop(name, None)
        return self

    def before(self, name: str, step: Step) -> Steps:
        self._of(name)
        self._around.setdefault(name, ([], []))[0].append(step)
        return self

    def after(self, name: str, step: Step) -> Steps:
        self._of(name)
        self._around.setdefault(name, ([], []))[1].append(step)
        return self

    def __contains__(self, name: str) -> bool:
        return name in self._steps

    def names(self) -> list[str]:
        return sorted(self._steps, key=lambda n: self._steps[n][:2])

    def _of(self, name: str) -> tuple[int, int, Step]:
        if name not in self._steps:
            raise KeyError(f"no step {name}; there are {', '.join(self.names()) or 'none'}")
        return self._steps[name]

    def _flat(self) -> Iterator[Step]:
        for name in self.names():
            before, after = self._around.get(name, ([], []))
            yield from (*before, self._steps[name][2], *after)

    def run(self, df: DataFrame) -> DataFrame:
        for step in self._flat():
            df = df.transform(step)
        return df
