"""Operators are values: a name, parameters and nested operators. Calling one builds the plan.

The same tree prints as XML, is read back, and can be shown as rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from ..model import AGFrame

#: Operators that give every node set once if they are given whole graphs, and those that give some of the node sets they are given.
ONCE_OF_WHOLE = frozenset(("node", "edge", "connected_component", "degree", "tree", "path", "graphlet", "clique"))
KEEP_SETS = frozenset((
    "filter_by_number_of_connected_components", "filter_by_number_of_nodes", "filter_by_number_of_edges", "filter_by_node_label", "filter_by_edge_label", "remove_redundant_mapped_subgraphs",
    "intersection_edges",
))
#: Operators whose parameter says how many nodes a subgraph has at most.
OF_A_SIZE = frozenset(("graphlet", "clique"))
#: How an operator deals with direction.
SUPPORT = ("agnostic", "preserve", "weak", "directed", "undirected_only")


@dataclass(frozen=True)
class Entry:
    name: str
    run: Callable
    support: str
    defaults: dict
    kind: str  # operator, control, binary or scalar
    doc: str


REGISTRY: dict[str, Entry] = {}


@dataclass(frozen=True)
class Op:
    name: str
    params: tuple[tuple[str, Any], ...] = ()
    children: tuple[Any, ...] = ()
    notes: tuple[tuple[str, str], ...] = ()

    def __call__(self, *frames: AGFrame):
        entry = REGISTRY[self.name]
        ag = frames[0]
        if not isinstance(ag, AGFrame):
            raise TypeError(f"{self.name} works on an AGFrame")
        if directed_support(self) == "undirected_only" and ag.directed:
            raise ValueError(f"{self.name} is for undirected graphs only")
        if entry.kind == "scalar":
            return entry.run(ag, **dict(self.params))
        if ag.chain is None:
            from ..plans.programs import to_xml

            frames = tuple(replace(f, chain=to_xml(self)) for f in frames)
            ag = frames[0]
            return replace(self._run(entry, frames), chain=None)
        return self._run(entry, frames)

    def _run(self, entry: Entry, frames: tuple[AGFrame, ...]) -> AGFrame:
        out = entry.run(*frames, *([self.children] if entry.kind == "control" else []), **dict(self.params))
        ag = frames[0]
        once = (self.name in ONCE_OF_WHOLE and ag.untouched and not (ag.directed and self.name == "edge")) or (self.name in KEEP_SETS and ag.distinct)
        out = replace(out, distinct=True) if once and not out.distinct else out
        if self.name in OF_A_SIZE:
            return replace(out, most=span((entry.defaults | dict(self.params))["number_of_nodes"])[1])
        return replace(out, most=ag.most) if self.name in KEEP_SETS else out

    def annotate(self, **notes: str) -> Op:
        return replace(self, notes=(*self.notes, *notes.items()))


def operator(name: str, support: str, kind: str = "operator", **defaults):
    """Register ``run`` under ``name``; what is returned makes a configured operator."""

    def wrap(run: Callable) -> Callable[..., Op]:
        REGISTRY[name] = Entry(name, run, support, defaults, kind, run.__doc__ or "")

        def make(*args, **params) -> Op:
            children = args if kind == "control" else ()
            if kind != "control":
                params = dict(zip(defaults, args, strict=False)) | params
            unknown = set(params) - set(defaults)
            if unknown:
                raise TypeError(f"{name} has no parameter {sorted(unknown)}")
            return Op(name, tuple((k, params[k]) for k in defaults if k in params), children)

        make.__name__, make.__doc__ = name, run.__doc__
        return make

    return wrap


def directed_support(op: Op) -> str:
    """An operator's own support, or the strictest of its children's."""
    order = {s: i for i, s in enumerate(SUPPORT)}
    own = REGISTRY[op.name].support if op.name in REGISTRY else "agnostic"
    nested = [directed_support(c) for c in _nested(op.children) if isinstance(c, Op)]
    return max([own, *nested], key=order.__getitem__)


def _nested(children):
    for c in children:
        if isinstance(c, (tuple, list)):
            yield from _nested(c)
        else:
            yield c


def span(value) -> tuple[int, int]:
    """A whole number means just that; a pair is an inclusive range."""
    if isinstance(value, bool) or not isinstance(value, (int, tuple)):
        raise TypeError(f"a whole number or a pair is wanted, not {value!r}")
    if isinstance(value, int):
        return value, value
    low, high = value
    return int(low), int(high)


def catalog(spark):
    """The registered operators as a DataFrame."""
    rows = [(e.name, e.kind, e.support, repr(e.defaults), e.doc.strip().split("\n")[0]) for e in REGISTRY.values()]
    return spark.createDataFrame(sorted(rows), "name string, kind string, directed_support string, defaults string, summary string")
