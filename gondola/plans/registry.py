"""Marts as pure functions of a context and their inputs; the registry knows the order."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Collection
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from gondola.plans.context import BuildContext


class Tables(dict[str, DataFrame]):
    """Tables by name."""


@dataclass(frozen=True)
class Mart:
    name: str
    needs: tuple[str, ...]
    grain: tuple[str, ...]
    build: Callable[[BuildContext, Tables], DataFrame]
    #: Read by several others, so written before they run.
    fan_out: bool = False
    #: For a mart with dates whose rows depend on the whole window: the columns that other marts' dates take from it.
    windowed: tuple[str, ...] = ()
    #: Dates before its own that a date's rows are made from.
    lag: int = 0

    @property
    def daily(self) -> bool:
        """Whether a date's rows are made from rows of that date (and the lag before it) alone, so that builds can share them."""
        return "snapshot_date" in self.grain and not self.windowed


MARTS: dict[str, Mart] = {}


def mart(name: str, needs: tuple[str, ...] = (), grain: tuple[str, ...] = (), fan_out: bool = False, windowed: tuple[str, ...] = (), lag: int = 0):
    def register(f: Callable[[BuildContext, Tables], DataFrame]):
        MARTS[name] = Mart(name, needs, grain, f, fan_out, windowed, lag)
        return f

    return register


def load() -> dict[str, Mart]:
    from gondola.operators import anomalies, basket, dims, dispersion, facts, health, index  # noqa: F401

    return MARTS


def ordered(only: set[str] | None = None) -> list[Mart]:
    """In an order in which inputs come first; with `only`, these and what they need."""
    marts = load()
    wanted = set(marts) if only is None else set()
    stack = list(only or ())
    while stack:
        name = stack.pop()
        if name in marts and name not in wanted:
            wanted.add(name)
            stack += marts[name].needs
    graph = {name: [n for n in marts[name].needs if n in marts] for name in sorted(wanted)}
    return [marts[name] for name in TopologicalSorter(graph).static_order()]


def build(ctx: BuildContext, sources: Tables, only: set[str] | None = None, keep: bool = False, also: Collection[str] = ()) -> Tables:
    """Lazy DataFrames of the marts on top of the sources; sources named like a mart replace it.

    keep: tables that several of the wanted marts read are marked to be kept in memory or on disk once computed, as
    the lineage would otherwise be computed anew for each reader, until the next call that keeps some. A build writes
    every mart instead. also: names that something beside the marts reads, such as the gates, once for each time.
    """
    if keep:
        release()
    tables, readers = Tables(sources), Counter(also)
    stack, seen = list(only or load()), set()
    while stack:  # only what the wanted marts reach, stopping at sources
        name = stack.pop()
        if name in seen or name in sources:
            continue
        seen.add(name)
        readers.update(load()[name].needs)
        stack += [n for n in load()[name].needs if n in load()]
    for m in ordered(only):
        if m.name in seen and m.name not in tables:
            tables[m.name] = m.build(ctx, tables)
    if keep:  # inputs first: a kept table's plan is fixed when it is marked, and reads what was kept before it
        for m in ordered(only):
            if readers[m.name] > 1 and m.fan_out:
                keep_table(tables[m.name])
    return tables


_kept: list[DataFrame] = []


def keep_table(df: DataFrame) -> DataFrame:
    """df, kept in memory or on disk once computed, until release()."""
    _kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return df


def release() -> None:
    """Lets go of the tables that an earlier build kept."""
    while _kept:
        _kept.pop().unpersist()
