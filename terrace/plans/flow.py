"""A data-preparation flow: named steps over DataFrames, each a plain function of its inputs, built lazily in their order."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators.quality import order_of
from .lineage import column_lineage, marked


@dataclass
class Flow:
    """Steps by name with the names of their inputs; sources are DataFrames. Nothing runs before a result is used."""

    sources: Mapping[str, DataFrame]
    steps: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = field(default_factory=dict)

    def step(self, name: str, fn: Callable[..., DataFrame], *inputs: str) -> Flow:
        self.steps[name] = (fn, inputs)
        return self

    def edges(self) -> list[tuple[str, str]]:
        return [(i, name) for name, (_, inputs) in self.steps.items() for i in inputs]

    def results(self, outputs: Sequence[str]) -> dict[str, DataFrame]:
        """The named results. An input that is not there, or a cycle, is an error."""
        missing = {i for i, _ in self.edges()} - self.steps.keys() - self.sources.keys()
        if missing:
            raise KeyError(f"no step or source {sorted(missing)}")
        made: dict[str, DataFrame] = dict(self.sources)
        for name in order_of(self.edges() + [(o, "") for o in outputs]):
            if name in self.steps and name not in made:
                fn, inputs = self.steps[name]
                made[name] = fn(*[made[i] for i in inputs])
        return {o: made[o] for o in outputs}

    def lineage(self) -> dict[str, set[str]]:
        """The sources that each step reads, directly or not."""
        out: dict[str, set[str]] = {s: {s} for s in self.sources}
        for name in order_of(self.edges()):
            if name in self.steps:
                out[name] = set().union(*(out[i] for i in self.steps[name][1]))
        return {n: out[n] for n in self.steps}

    def column_lineage(self, output: str) -> tuple[dict[str, set[str]], set[str]]:
        """Of an output: the sources' columns ("source::column") that each of its columns is made from, and those that decide on its rows."""
        told = Flow({n: marked(n, df) for n, df in self.sources.items()}, self.steps)
        return column_lineage(told.results([output])[output])

    def profile(self) -> dict[str, int]:
        """Numbers of inputs, steps and outputs, and the longest chain."""
        depth: dict[str, int] = {}
        for name in order_of(self.edges()):
            depth[name] = 1 + max((depth[i] for i in self.steps[name][1]), default=0) if name in self.steps else 0
        used = {i for i, _ in self.edges()}
        return {"inputs": len(self.sources), "steps": len(self.steps), "outputs": len([s for s in self.steps if s not in used]), "depth": max(depth.values(), default=0)}
