"""A registry of builders: each makes one representation of documents out of others that it names; a request builds what it needs, in order, and nothing else."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from docweft.operators import chunking, graph, text
from docweft.shared import cut


@dataclass(frozen=True)
class Builder:
    """name: what it makes; needs: what its function takes, as DataFrames in this order; version: a part of what its results are known by."""

    name: str
    needs: tuple[str, ...]
    build: Callable[..., DataFrame]
    version: str = "1"


class Registry:
    def __init__(self, builders: Iterable[Builder] = ()):
        self.builders: dict[str, Builder] = {}
        for b in builders:
            self.add(b)

    def add(self, builder: Builder) -> None:
        """A further builder; one of the same name is replaced. Needs that nobody builds are sources, which a request has to bring."""
        self.builders[builder.name] = builder

    def order(self, wanted: Iterable[str], given: Iterable[str] = ()) -> list[str]:
        """The builders that `wanted` needs beside what is given, each after what it needs. An error for a cycle, or for what is neither given nor built."""
        given, found, open_ = set(given), [], []

        def visit(name: str) -> None:
            if name in given or name in found:
                return
            if name in open_:
                raise ValueError("builders need each other: " + " > ".join([*open_[open_.index(name) :], name]))
            if name not in self.builders:
                raise KeyError(f"nobody builds {name}, and it isn't given")
            open_.append(name)
            for need in self.builders[name].needs:
                visit(need)
            open_.pop()
            found.append(name)

        for name in wanted:
            visit(name)
        return found

    def downstream(self, changed: Iterable[str]) -> list[str]:
        """The changed representations that are built and all that is built from them, in order."""
        hit = set(changed)
        while more := {b.name for b in self.builders.values() if hit & set(b.needs)} - hit:
            hit |= more
        whole = self.order(list(self.builders), [n for b in self.builders.values() for n in b.needs if n not in self.builders])
        return [name for name in whole if name in hit]

    def run(self, wanted: Iterable[str], given: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The wanted representations. What more than one builder of the request needs is written once to the shared folder."""
        wanted = list(wanted)
        order = self.order([w for w in wanted if w not in given], given)
        users = {n: sum(n in self.builders[o].needs for o in order) for n in order}
        made = dict(given)
        for name in order:
            b = self.builders[name]
            df = b.build(*(made[n] for n in b.needs))
            made[name] = cut(df) if users[name] > 1 else df
        return {name: made[name] for name in wanted}

    def rebuild(self, changed: Iterable[str], stored: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """What must be built anew after changes, from stored representations that are still good; what is not affected is neither built nor returned."""
        todo = self.downstream(changed)
        return self.run(todo, {name: df for name, df in stored.items() if name not in todo})


def documents() -> Registry:
    """The builders of this library, from a table documents (doc_id, text)."""
    return Registry(
        [
            Builder("blocks", ("documents",), text.blocks),
            Builder("sections", ("blocks",), text.sections),
            Builder("graph", ("blocks",), graph.nodes),
            Builder("edges", ("graph",), graph.edges),
            Builder("layout", ("graph",), chunking.layout),
            Builder("chunks", ("documents",), text.chunks),
            Builder("hints", ("chunks",), text.chunk_hints),
        ]
    )
