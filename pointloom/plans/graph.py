"""A small typed graph of named operations on DataFrames: registry, builder, groups, JSON, ticks with feedback.

A node holds a function of DataFrames; nothing runs before ``pull``, which composes one plan and leaves it to Spark.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Op:
    """A named operation: ``run(*inputs, **params)``; ``needs``: the columns each input must have."""

    name: str
    run: Callable[..., DataFrame]
    needs: tuple[tuple[str, ...], ...] = ()
    defaults: dict[str, Any] = field(default_factory=dict)


_OPS: dict[str, Op] = {}


def register(op: Op) -> Op:
    if op.name in _OPS:
        raise ValueError(f"there is an operation {op.name!r} already")
    _OPS[op.name] = op
    return op


def get_op(name: str) -> Op:
    return _OPS[name]


def list_ops() -> list[str]:
    return sorted(_OPS)


@dataclass
class Node:
    name: str
    op: str
    inputs: tuple[str, ...]
    params: dict[str, Any]


class Graph:
    """Sources by name and nodes over them; a delayed input is the value of the tick before."""

    def __init__(self):
        self.sources: dict[str, DataFrame] = {}
        self.nodes: dict[str, Node] = {}
        self.delays: dict[str, tuple[str, str]] = {}
        self._memo: dict[str, DataFrame] = {}

    def source(self, name: str, df: DataFrame) -> str:
        self._free(name)
        self.sources[name] = df
        return name

    def op(self, op: str, *inputs: str, name: str | None = None, **params) -> str:
        known = get_op(op)
        if len(known.needs) != len(inputs):
            raise ValueError(f"{op} takes {len(known.needs)} inputs")
        unknown = set(params) - set(known.defaults)
        if unknown:
            raise ValueError(f"{op} has no parameter {sorted(unknown)}")
        name = name or f"n{len(self.nodes)}"
        self._free(name)
        for i in inputs:
            if i not in self.sources and i not in self.nodes and i not in self.delays:
                raise KeyError(i)
        self.nodes[name] = Node(name, op, inputs, {**known.defaults, **params})
        return name

    def delay(self, name: str, initial: str) -> str:
        """An input that ``close`` later ties to a node: its value of the tick before, at first ``initial``'s."""
        self._free(name)
        self.delays[name] = (initial, "")
        return name

    def close(self, name: str, node: str) -> None:
        self.delays[name] = (self.delays[name][0], node)

    def _free(self, name: str) -> None:
        if name in self.sources or name in self.nodes or name in self.delays:
            raise ValueError(f"the name {name!r} is taken")

    def pull(self, name: str) -> DataFrame:
        """The plan of a node; nodes that are used twice are planned once."""
        if name in self.sources:
            return self.sources[name]
        if name in self.delays:
            return self._memo[name] if name in self._memo else self.pull(self.delays[name][0])
        if name not in self._memo:
            node = self.nodes[name]
            inputs = [self.pull(i) for i in node.inputs]
            for df, needs in zip(inputs, get_op(node.op).needs, strict=True):
                if missing := set(needs) - set(df.columns):
                    raise ValueError(f"{name}: columns {sorted(missing)} are missing")
            self._memo[name] = get_op(node.op).run(*inputs, **node.params)
        return self._memo[name]

    def advance(self, ticks: int = 1, *, every: int = 4) -> None:
        """Ticks on: each delayed input becomes its node's value; long loops are cut by checkpoints."""
        from pointloom.operators.lineage import cut

        for k in range(ticks):
            new = {d: self.pull(node) for d, (_, node) in self.delays.items()}
            if (k + 1) % every == 0:
                new = {d: cut(df) for d, df in new.items()}
            self._memo = new

    def to_json(self) -> str:
        """The nodes and delays; sources are data and stay out."""
        nodes = [{"name": n.name, "op": n.op, "inputs": list(n.inputs), "params": n.params} for n in self.nodes.values()]
        delays = [{"name": d, "initial": i, "node": n} for d, (i, n) in self.delays.items()]
        return json.dumps({"nodes": nodes, "delays": delays}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str, sources: dict[str, DataFrame]) -> Graph:
        """Builds nodes in an order that their inputs allow; raises at a cycle without a delay."""
        data, g = json.loads(text), cls()
        for name, df in sources.items():
            g.source(name, df)
        for d in data["delays"]:
            g.delay(d["name"], d["initial"])
        left = expand_instances(data)
        while left:
            ready = [n for n in left if all(i in g.sources or i in g.nodes or i in g.delays for i in n["inputs"])]
            if not ready:
                raise ValueError(f"a cycle or an unknown input: {sorted(n['name'] for n in left)}")
            for n in ready:
                g.op(n["op"], *n["inputs"], name=n["name"], **n["params"])
            left = [n for n in left if n not in ready]
        for d in data["delays"]:
            g.close(d["name"], d["node"])
        return g


def expand_instances(data: dict) -> list[dict]:
    """Nodes with instances of ``groups`` replaced by the group's nodes; a group within itself is refused.

    An instance is a node whose op is a group's name; its inputs stand for the group's ``inputs``, its name for the
    group's ``output``.
    """
    groups = data.get("groups", {})

    def expand(nodes: list[dict], open_: tuple[str, ...]) -> list[dict]:
        out = []
        for n in nodes:
            if n["op"] not in groups:
                out.append(n)
                continue
            if n["op"] in open_:
                raise ValueError(f"the group {n['op']!r} holds itself")
            g = groups[n["op"]]
            names = dict(zip(g["inputs"], n["inputs"], strict=True)) | {m["name"]: f"{n['name']}/{m['name']}" for m in g["nodes"]}
            names[g["output"]] = n["name"]
            inner = [{**m, "name": names[m["name"]], "inputs": [names.get(i, i) for i in m["inputs"]]} for m in g["nodes"]]
            out += expand(inner, (*open_, n["op"]))
        return out

    return expand(data["nodes"], ())


def _register_all() -> None:
    from pointloom.operators import raster, simulate

    grid = ("y", "x", "v")
    register(Op("addGrids", lambda a, b, wa, wb: raster.add_grids(a, b, wa, wb), (grid, grid), {"wa": 1.0, "wb": 1.0}))
    register(Op("threshold", lambda g, at, softness: raster.threshold(g, at, softness), (grid,), {"at": 0.5, "softness": None}))
    register(Op("boxSum", lambda g, radius: raster.box_sum(g, radius), (grid,), {"radius": 2}))
    register(Op("gaussian", lambda g, radius: raster.convolve(g, raster.gaussian_weights(radius)), (grid,), {"radius": 2}))
    register(Op("getisOrd", lambda g, radius: raster.getis_ord(g, radius), (grid,), {"radius": 2}))
    register(Op("laplacian", lambda g: raster.laplacian(g, "v", "lap").selectExpr("y", "x", "lap AS v"), (grid,)))
    register(Op("reactionDiffusion", lambda s, steps: simulate.gray_scott(s, steps), (("y", "x", "u", "v"),), {"steps": 1}))


_register_all()
