"""Pipelines as data: a JSON spec is checked, resolved against a registry of operators, and folded into DataFrames."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter
from typing import Any

SECTIONS = ("objects", "nodes", "edges", "chain")


@dataclass
class Registry:
    """What a spec may construct, by name. Nothing is imported by a name that a spec holds."""

    known: dict[str, Callable[..., Any]] = field(default_factory=dict)

    def add(self, name: str, make: Callable[..., Any]) -> None:
        if name in self.known:
            raise ValueError(f"{name} is registered already")
        self.known[name] = make

    def get(self, name: str) -> Callable[..., Any]:
        if name not in self.known:
            raise KeyError(f"no operator is registered as {name}")
        return self.known[name]


def typed(spec: Mapping, key: str, kind: type) -> Any:
    """A required value of ``kind``; numbers and booleans may be given as text."""
    if spec.get(key) is None:
        raise ValueError(f"{key} is missing")
    value = spec[key]
    if isinstance(value, kind) and not (kind is int and isinstance(value, bool)):
        return value
    if isinstance(value, str) and kind is bool and value.lower() in ("true", "false"):
        return value.lower() == "true"
    if isinstance(value, str) and kind in (int, float):
        return kind(value)
    if kind is float and isinstance(value, int):
        return float(value)
    raise TypeError(f"{key} is not of type {kind.__name__}")


def _references(value: Any) -> set[str]:
    if isinstance(value, Mapping):
        own = {value["ref"]} if "ref" in value else set(value.get("refs", ())) | set((value.get("ref_map") or {}).values())
        return own.union(*[_references(v) for k, v in value.items() if k not in ("ref", "refs", "ref_map")], set())
    if isinstance(value, list):
        return set().union(*[_references(v) for v in value], set())
    return set()


@dataclass
class Spec:
    """``objects``: name -> {type, args, reuse}; ``nodes``: the same for operators; ``edges``: from -> [to]; ``chain``: names that run."""

    objects: dict[str, dict]
    nodes: dict[str, dict]
    edges: dict[str, list[str]]
    chain: list[str]

    @classmethod
    def parse(cls, text: str) -> Spec:
        raw = json.loads(text)
        for section in SECTIONS:
            if section not in raw:
                raise ValueError(f"section {section} is missing")
        if both := set(raw["objects"]) & set(raw["nodes"]):
            raise ValueError(f"names are used twice: {sorted(both)}")
        spec = cls(raw["objects"], raw["nodes"], raw["edges"], raw["chain"])
        spec.check()
        return spec

    def check(self) -> None:
        """References exist and run in no circle; the chain is one graph without circles, one root, one leaf, all reachable."""
        everything = self.objects | self.nodes
        needs = {name: set().union(*[_references(v) for v in body.get("args", {}).values()], set()) for name, body in everything.items()}
        for name, refs in needs.items():
            if unknown := refs - set(everything):
                raise ValueError(f"{name} refers to {sorted(unknown)}, which do not exist")
        _sorted(needs)
        if not self.chain:
            raise ValueError("no chain runs")
        chain_order(self.chain, self.edges)


def _sorted(needs: Mapping[str, set[str]]) -> list[str]:
    try:
        return list(TopologicalSorter(needs).static_order())
    except CycleError as e:
        raise ValueError(f"a circle: {' -> '.join(e.args[1])}") from None


def chain_order(chain: list[str], edges: Mapping[str, list[str]]) -> list[str]:
    """Nodes of a chain so that each comes after those it reads from."""
    if len(set(chain)) != len(chain):
        raise ValueError("a node stands twice in a chain")
    for a, targets in edges.items():
        if outside := {a, *targets} - set(chain):
            raise ValueError(f"edges lead outside the chain: {sorted(outside)}")
    reads = {n: {a for a, targets in edges.items() if n in targets} for n in chain}
    order = _sorted(reads)
    roots, leaves = [n for n in chain if not reads[n]], [n for n in chain if not edges.get(n)]
    if len(roots) != 1 or len(leaves) != 1:
        raise ValueError(f"a chain has one root and one leaf, not {roots} and {leaves}")
    seen, todo = set(), roots[:]
    while todo:
        seen.add(n := todo.pop())
        todo += [t for t in edges.get(n, ()) if t not in seen]
    if seen != set(chain):
        raise ValueError(f"not reachable: {sorted(set(chain) - seen)}")
    return order


def lane_numbers(edges: Mapping[str, list[str]], root: str, width: Mapping[str, int]) -> dict[tuple[str, int], tuple[str, int]]:
    """(node, output lane) -> (node, input lane), by connecting free lanes in order while going depth first.

    A node's first child takes the lowest free lanes with its whole subtree before the second child is looked at.
    """
    out_free, in_free, done = dict.fromkeys(width, 0), dict.fromkeys(width, 0), {}
    seen: set[str] = set()

    def visit(node: str) -> None:
        if node in seen:
            return
        seen.add(node)
        for child in edges.get(node, ()):
            n = min(width[node] - out_free[node], width[child] - in_free[child])
            if n < 1:
                raise ValueError(f"no free lane from {node} to {child}")
            for _ in range(n):
                done[(node, out_free[node])] = (child, in_free[child])
                out_free[node] += 1
                in_free[child] += 1
            visit(child)

    visit(root)
    return done


class Builder:
    """Makes a spec's objects; one marked ``reuse`` (the default) is made once, others each time they are referred to."""

    def __init__(self, spec: Spec, registry: Registry, given: Mapping[str, Any] | None = None):
        self.spec, self.registry, self.made = spec, registry, dict(given or {})

    def make(self, name: str) -> Any:
        if name in self.made:
            return self.made[name]
        body = (self.spec.objects | self.spec.nodes)[name]
        times = self.value(body.get("times", 1))
        make = self.registry.get(typed(body, "type", str))
        args = {k: self.value(v) for k, v in body.get("args", {}).items()}
        out = make(**args) if times == 1 else [make(**args) for _ in range(times)]
        if body.get("reuse", True):
            self.made[name] = out
        return out

    def value(self, v: Any) -> Any:
        """A constant, {"ref": name}, {"refs": [names]} or {"ref_map": {key: name}}."""
        if isinstance(v, Mapping):
            if "ref" in v:
                return self.make(v["ref"])
            if "refs" in v:
                return [self.make(n) for n in v["refs"]]
            if "ref_map" in v:
                return {k: self.make(n) for k, n in v["ref_map"].items()}
            return {k: self.value(x) for k, x in v.items()}
        return [self.value(x) for x in v] if isinstance(v, list) else v

    def run(self, *given: Any) -> Any:
        """Fold the chain: each node is called with the outputs of those it reads from, the root with ``given``; the leaf's output is returned.

        With ``given`` a chain is open: a function of the streams that enter it, to be a node of another chain.
        """
        order, outputs = chain_order(self.spec.chain, self.spec.edges), {}
        for node in order:
            inputs = [outputs[a] for a in order if node in self.spec.edges.get(a, ())]
            outputs[node] = self.make(node)(*(inputs or given))
        return outputs[order[-1]]


def composite(receive: Callable[..., Any], transmit: Callable[[Any], Any], between: Callable[[], None] | None = None) -> Callable[..., Any]:
    """One node of two: what ``receive`` makes of the input goes to ``transmit``; ``between`` is called once the first is through."""

    def run(*inputs: Any) -> Any:
        received = receive(*inputs)
        if between:
            between()
        return transmit(received)

    return run


class Junction:
    """A node with a second output, which must be fetched exactly once, before the junction runs."""

    def __init__(self):
        self.fetched, self.ran, self.stream = False, False, None

    def second(self) -> Callable[[], Any]:
        """The second output, as the root of another chain."""
        if self.fetched:
            raise ValueError("the junction's second output is fetched already")
        self.fetched = True

        def root() -> Any:
            if not self.ran:
                raise ValueError("the junction has not run yet")
            return self.stream

        return root

    def __call__(self, stream: Any) -> Any:
        if not self.fetched:
            raise ValueError("nothing fetches the junction's second output")
        self.ran, self.stream = True, stream
        return stream


class Application:
    """Several closed chains over the same objects and nodes: sections objects, nodes and chains, by name, each with chain and edges.

    All nodes are made before any chain runs. A chain with a node that refers to one of another chain runs after it,
    else chains run in the order of their names.
    """

    def __init__(self, text: str, registry: Registry, given: Mapping[str, Any] | None = None):
        raw = json.loads(text)
        for section in ("objects", "nodes", "chains"):
            if not raw.get(section) and section != "objects":
                raise ValueError(f"section {section} is missing or empty")
        objects, nodes = raw.get("objects", {}), raw["nodes"]
        if both := set(objects) & set(nodes):
            raise ValueError(f"names are used twice: {sorted(both)}")
        self.specs = {}
        for name, c in sorted(raw["chains"].items()):
            self.specs[name] = Spec(objects, nodes, c["edges"], c["chain"])
            self.specs[name].check()
        inside = [n for s in self.specs.values() for n in s.chain]
        if len(set(inside)) != len(inside):
            raise ValueError("a node stands in two chains")
        self.builder = Builder(next(iter(self.specs.values())), registry, given)

    def run(self) -> dict[str, Any]:
        """Each chain's output by its name."""
        owner = {n: name for name, s in self.specs.items() for n in s.chain}
        nodes = next(iter(self.specs.values())).nodes
        needs = {name: {owner[r] for n in s.chain for r in _references(nodes[n].get("args", {})) if owner.get(r, name) != name} for name, s in self.specs.items()}
        for name in self.specs:
            for n in self.specs[name].chain:
                self.builder.make(n)
        out = {}
        for name in _sorted(needs):
            self.builder.spec = self.specs[name]
            out[name] = self.builder.run()
        return out
