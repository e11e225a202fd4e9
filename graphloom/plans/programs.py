"""Programs as text: XML out and in, and a program shown as rows."""

from __future__ import annotations

import ast
import xml.etree.ElementTree as ET
from collections.abc import Callable
from pathlib import Path

from ..operators.registry import REGISTRY, Op

#: Element names, and names of operators in older files.
OLD_NAMES = {"product": "compose_product", "pairwise_intersection": "intersection"}
CALLABLES: dict[str, Callable] = {}


def register_callable(name: str, fn: Callable) -> Callable:
    """Make a predicate, combiner or function known by a name, so that programs that use it can be read back."""
    CALLABLES[name] = fn
    return fn


def _element(x) -> ET.Element:
    if isinstance(x, Op):
        e = ET.Element("Operator", {"type": x.name} | {k: _value(v) for k, v in x.params})
        for k, v in x.notes:
            ET.SubElement(e, "Annotation", {"key": k}).text = v
        for c in x.children:
            ET.SubElement(e, "Combiner" if x.name == "compose_product" and c is x.children[0] else "Child").append(_element(c))
        return e
    if isinstance(x, (tuple, list)):
        e = ET.Element("Case")
        for c in x:
            e.append(_element(c))
        return e
    return ET.Element("Ref", {"name": _name(x)})


def _name(fn: Callable) -> str:
    return next((k for k, v in CALLABLES.items() if v is fn), getattr(fn, "__name__", "callable"))


def _value(v) -> str:
    return f"ref:{_name(v)}" if callable(v) else repr(v)


def to_xml(op: Op) -> str:
    return ET.tostring(_element(op), encoding="unicode")


def _read(e: ET.Element):
    if e.tag == "Ref":
        if e.get("name") not in CALLABLES:
            raise ValueError(f"no callable is registered as {e.get('name')!r}")
        return CALLABLES[e.get("name")]
    if e.tag == "Case":
        return tuple(_read(c) for c in e)
    if e.tag != "Operator":
        raise ValueError(f"unknown element {e.tag!r}")
    name = OLD_NAMES.get(e.get("type"), e.get("type"))
    if name not in REGISTRY:
        raise ValueError(f"unknown operator {name!r}")
    params = {k: _back(v) for k, v in e.attrib.items() if k != "type"}
    unknown = set(params) - set(REGISTRY[name].defaults)
    if unknown:
        raise ValueError(f"{name} has no parameter {sorted(unknown)}")
    children = tuple(_read(c[0]) for c in e if c.tag in ("Child", "Combiner"))
    notes = tuple((c.get("key"), c.text or "") for c in e if c.tag == "Annotation")
    return Op(name, tuple((k, params[k]) for k in REGISTRY[name].defaults if k in params), children, notes)


def _back(text: str):
    if text.startswith("ref:"):
        return CALLABLES[text[4:]]
    return ast.literal_eval(text)


def from_xml(text: str) -> Op:
    return _read(ET.fromstring(text))


def save(op: Op, path: str) -> str:
    Path(path).write_text(to_xml(op), encoding="utf-8")
    return path


def load(path: str) -> Op:
    return from_xml(Path(path).read_text(encoding="utf-8"))


#: Operators whose results have a number of nodes that a parameter bounds: the parameter, its default, and how many nodes more it means.
SIZED = {"clique": ("number_of_nodes", (1, 3), 0), "graphlet": ("number_of_nodes", (1, 3), 0), "path": ("number_of_edges", (1, 3), 1)}


def _bounded(op, size_filter: Op) -> Op | None:
    """The operator made to give only what the filter after it lets through, if its parameters can say so."""
    if not isinstance(op, Op) or op.name not in SIZED:
        return None
    name, default, more = SIZED[op.name]
    as_pair = lambda x: (x, x) if isinstance(x, int) else tuple(x)
    own, wanted = as_pair(dict(op.params).get(name, default)), as_pair(dict(size_filter.params).get("number_of_nodes", (1, 10)))
    low, high = max(own[0], wanted[0] - more), min(own[1], wanted[1] - more)
    if low > high:
        return None
    params = dict(op.params) | {name: (low, high)}
    return Op(op.name, tuple((k, params[k]) for k in REGISTRY[op.name].defaults if k in params), op.children, op.notes)


def simplified(op: Op) -> Op:
    """The same node sets with less work: identities, deduplication of what is distinct, size filters next to each other, and
    those after an operator that can bound the size itself.

    A stage of a compose or forward_compose deduplicates what it gives, unless ``dedup`` is off. So an identity that comes first
    there still deduplicates, and becomes just that; later ones do nothing. A compose of one operator stays.
    """
    if not isinstance(op, Op):
        return op
    children = tuple(tuple(simplified(x) for x in c) if isinstance(c, (tuple, list)) else simplified(c) for c in op.children)
    if op.name in ("compose", "forward_compose"):
        dedup = dict(op.params).get("dedup", True)
        stages = children if op.name == "forward_compose" else children[::-1]
        kept: list = []
        for c in stages:
            name = c.name if isinstance(c, Op) else None
            same = bool(kept) and isinstance(kept[-1], Op) and name == kept[-1].name
            if name == "identity" and len(children) > 1:
                if dedup and not kept:
                    kept.append(Op("deduplicate"))
                continue
            if name == "deduplicate" and (same or (dedup and kept)):
                continue
            if same and name == "filter_by_number_of_nodes":
                a, b = (dict(x.params).get("number_of_nodes", (1, 10)) for x in (kept[-1], c))
                a, b = ((x, x) if isinstance(x, int) else x for x in (a, b))
                kept[-1] = Op(name, (("number_of_nodes", (max(a[0], b[0]), min(a[1], b[1]))),))
                continue
            bounded = _bounded(kept[-1], c) if name == "filter_by_number_of_nodes" and kept else None
            if bounded is not None:
                kept[-1] = bounded
                continue
            kept.append(c)
        kept = kept or list(stages[:1])
        children = tuple(kept if op.name == "forward_compose" else kept[::-1])
    return Op(op.name, op.params, children, op.notes)


def explain_program(spark, op: Op):
    """id, parent, name, params: the program's tree, one row per operator."""
    rows: list[tuple] = []

    def walk(x, parent):
        if isinstance(x, (tuple, list)):
            for c in x:
                walk(c, parent)
        else:
            me = len(rows)
            rows.append((me, parent, x.name if isinstance(x, Op) else _name(x), repr(dict(x.params)) if isinstance(x, Op) else ""))
            for c in x.children if isinstance(x, Op) else ():
                walk(c, me)

    walk(op, None)
    return spark.createDataFrame(rows, "id long, parent long, name string, params string")
