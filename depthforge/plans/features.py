"""Stateful features as trees of nodes, compiled to few passes over the data.

A node has a name, an expression over the columns and over its children's names, and the children.  Children come
first; all decayed sums that can be ready together run in one fold, and equal ones (input, half-life, kind) once.

The library's nodes have trees as expressions (:mod:`depthforge.plans.expressions`), so that they can be written as JSON
and read back; a function serves as well, but then the node can only be described.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthforge.functions import exprs as X
from depthforge.functions.durations import half_life_ns
from depthforge.operators.kernels import Decay, decayed
from depthforge.operators.ordering import KEYS, ORDER, by_row, carry_forward
from depthforge.plans.expressions import Tree, call, col

#: Expressions get the row window, as some look at the previous row.
Expr = Callable[[object], Column]


@dataclass(frozen=True)
class Node:
    name: str
    expr: Expr
    children: tuple = ()
    config: dict = field(default_factory=dict, compare=False)

    def to_config(self) -> dict:
        expr = {"expr": self.expr.to_config()} if isinstance(self.expr, Tree) else {}
        return {"kind": type(self).__name__, "name": self.name, **self.config, **expr, "children": [c.to_config() for c in self.children]}


@dataclass(frozen=True)
class CarryForward(Node):
    """The last value of the expression that isn't null, before the row."""


@dataclass(frozen=True)
class Ewma(Node):
    """Decayed sum of the expression, or normalised average.

    ``tag`` names the input; nodes of equal tag, half-life and kind are computed once.
    """

    half_life: str | float = "1m"
    normalized: bool = False
    tag: str = ""

    def to_config(self):
        half_life = self.half_life.total_seconds() if isinstance(self.half_life, timedelta) else self.half_life
        return {**super().to_config(), "half_life": half_life, "normalized": self.normalized, "tag": self.tag}


KINDS = {c.__name__: c for c in (Node, CarryForward, Ewma)}


def from_config(config: dict, known: dict[str, Node] | None = None) -> Node:
    """The node that ``config`` describes; nodes of one name are read once and shared, through ``known``."""
    known = {} if known is None else known
    if config.get("kind") not in KINDS:
        raise ValueError(f"unknown kind of node: {config.get('kind')}")
    if "expr" not in config:
        raise ValueError(f"{config.get('name')}: its expression was a function, which can't be read back")
    name = config["name"]
    if name in known:
        if known[name].to_config() != config:
            raise ValueError(f"names used twice: [{name!r}]")
        return known[name]
    children = tuple(from_config(c, known) for c in config["children"])
    own = {k: config[k] for k in ("half_life", "normalized", "tag") if config["kind"] == "Ewma"}
    rest = {k: v for k, v in config.items() if k not in ("kind", "name", "expr", "children", *own)}
    known[name] = KINDS[config["kind"]](name, Tree.from_config(config["expr"]), children, rest, **own)
    return known[name]


def to_json(static: dict[str, Tree], features: Sequence[Node]) -> str:
    """Static columns and features as text."""
    return json.dumps({"version": 1, "static": {n: t.to_config() for n, t in static.items()}, "features": [f.to_config() for f in features]})


def from_json(text: str) -> tuple[dict[str, Tree], list[Node]]:
    body = json.loads(text)
    if body.get("version") != 1:
        raise ValueError(f"feature version {body.get('version')}")
    known: dict[str, Node] = {}
    return {n: Tree.from_config(t) for n, t in body["static"].items()}, [from_config(f, known) for f in body["features"]]


def nodes_of(node: Node) -> list[Node]:
    """The node and all below it, each once, children first."""
    out: list[Node] = []
    for c in node.children:
        out += [n for n in nodes_of(c) if not any(n is m for m in out)]
    return [*out, node]


def names(node: Node) -> list[str]:
    return [n.name for n in nodes_of(node)]


def check(features: Sequence[Node]) -> None:
    """Two different nodes of one name are an error; one node may serve several."""
    every: list[Node] = []
    for f in features:
        every += [n for n in nodes_of(f) if not any(n is m for m in every)]
    own = [n.name for n in every]
    if len(own) != len(set(own)):
        raise ValueError(f"names used twice: {sorted({n for n in own if own.count(n) > 1})}")


def add_features(df: DataFrame, features: Sequence[Node | CustomFeature], keys: Sequence[str] = KEYS, order: str = ORDER, time: str = "ts_ns") -> DataFrame:
    """``df`` with a column for each feature, states running along ``order`` within ``keys``."""
    nodes = [f for f in features if isinstance(f, Node)]
    check(nodes)
    every: dict[str, Node] = {}

    def visit(n: Node):
        for c in n.children:
            visit(c)
        every.setdefault(n.name, n)

    for f in nodes:
        visit(f)
    w, alias, done = by_row(keys, order), {}, set()
    out = df.repartition(*keys) if keys else df.repartition(1)  # the one shuffle, unless windows follow a fold
    left = list(every.values())
    while left:
        ready = [n for n in left if all(c.name in done for c in n.children)]
        # expressions first, so that a fold takes all the sums there are
        plain = [n for n in ready if not isinstance(n, Ewma)]
        sums = [] if plain else ready
        if plain:
            out = out.withColumns({n.name: carry_forward(X.num(n.expr(w)), keys, order) if isinstance(n, CarryForward) else n.expr(w) for n in plain})
        if sums:
            inputs, decays, copies = {}, [], {}
            for n in sums:
                value = f"__in_{n.tag or n.name}"
                inputs.setdefault(value, X.num(n.expr(w)))
                key = (value, half_life_ns(n.half_life), n.normalized)
                if key in alias:
                    copies[n.name] = alias[key]
                else:
                    alias[key] = n.name
                    decays.append(Decay(n.name, value, key[1], n.normalized))
            out = decayed(out.withColumns(inputs), decays, keys, order, time, placed=True).drop(*inputs)
            out = out.withColumns({k: F.col(c) for k, c in copies.items()}) if copies else out
        done |= {n.name for n in plain + sums}
        left = [n for n in left if n.name not in done]
    wanted = {f.name for f in nodes}
    out = out.drop(*(n for n in every if n not in wanted))
    for f in features:
        if not isinstance(f, Node):
            out = f.apply(out)
    return out


class CustomFeature:
    """A user's own stateful feature."""

    name: str

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def to_config(self) -> dict:
        return {"kind": type(self).__name__, "name": self.name}


# ---------------------------------------------------------------- the library


def momentum(name: str, half_life, mode: str = "trade", log: bool = False, unit: bool = False, normalized: bool = False, combine: str = "diff", eps: float = 1e-12) -> Node:
    """Buying against selling flow, each per decayed average top volume."""
    X.flows(mode, by_row(), unit)  # checks the mode
    X.combine_flows(F.lit(0.0), F.lit(0.0), combine, log, eps)
    kind = f"{mode}_{'unit' if unit else 'size'}"
    buy, sell = (Ewma(f"__{name}_{side}", call("flow", mode, side, unit), half_life=half_life, normalized=normalized, tag=f"{side}_{kind}") for side in ("buy", "sell"))
    volume = Ewma(f"__{name}_volume", call("bbo_volume"), half_life=half_life, normalized=True, tag="bbo_volume")
    per = call("greatest", col(volume.name), call("lit", eps))
    expr = call("combine_flows", call("over", col(buy.name), per), call("over", col(sell.name), per), combine, log, eps)
    return Node(name, expr, (buy, sell, volume), {"momentum": {"half_life": _plain(half_life), "mode": mode, "log": log, "unit": unit, "normalized": normalized, "combine": combine}})


def _plain(half_life):
    return half_life.total_seconds() if isinstance(half_life, timedelta) else half_life


def trade_momentum(name, half_life, **kw) -> Node:
    return momentum(name, half_life, "trade", **kw)


def push_momentum(name, half_life, **kw) -> Node:
    return momentum(name, half_life, "push", **kw)


def pull_momentum(name, half_life, **kw) -> Node:
    return momentum(name, half_life, "pull", **kw)


def trade_correlation(name: str, half_life, mode: str = "side", eps: float = 1e-12) -> Node:
    """Decayed autocorrelation of successive trades' signs or signed volumes; null until there was a pair."""
    X.signed_trade(mode)
    value = call("signed_trade", mode)
    prev = CarryForward(f"__{name}_prev", call("if", call("is_trade"), value))
    pair = call("is_trade") & ~call("is_null", col(prev.name))
    avg = lambda k, x: Ewma(f"__{name}_{k}", call("if", pair, x), (prev,), half_life=half_life, normalized=True, tag=f"{name}_{k}")
    v, vv = avg("v", value), avg("vv", col(prev.name) * value)
    mass = Ewma(f"__{name}_mass", call("if", pair, 1.0, 0.0), (prev,), half_life=half_life, tag=f"{name}_mass")
    v2 = avg("v2", value * value) if mode == "volume" else None
    m, q = col(v.name), col(vv.name)
    spread = (col(v2.name) if v2 else call("lit", 1.0)) - m * m
    rho = call("least", call("greatest", (q - m * m) / (spread + eps), -1.0), 1.0)
    return Node(name, call("if", col(mass.name) > eps, rho), (v, vv, mass, *((v2,) if v2 else ())), {"correlation": {"half_life": _plain(half_life), "mode": mode}})


def flow_return(name: str, inner_half_life, outer_half_life, form: str = "corr", mode: str = "trade", momentum_log: bool = False, eps: float = 1e-12) -> Node:
    """Decayed product of the momentum before a row and the row's return; ``corr``: over decayed absolute returns."""
    if form not in ("sum", "corr"):
        raise ValueError("flow response form is sum or corr")
    if half_life_ns(outer_half_life) < 10 * half_life_ns(inner_half_life):
        raise ValueError("the outer half-life is at least ten times the inner one")
    flow = momentum(f"__{name}_flow", inner_half_life, mode, log=momentum_log, eps=eps)
    prev = CarryForward(f"__{name}_prev", col(flow.name), (flow,))
    ret = call("log_mid_return") * 1e4
    top = Ewma(f"__{name}_top", col(prev.name) * ret, (prev,), half_life=outer_half_life)
    config = {"flow_return": {"inner_half_life": _plain(inner_half_life), "outer_half_life": _plain(outer_half_life), "form": form, "mode": mode}}
    if form == "sum":
        return Node(name, col(top.name), (top,), config)
    size = Ewma(f"__{name}_size", call("abs", ret), half_life=outer_half_life, tag="abs_return_bps")
    return Node(name, call("if", col(size.name) > eps, col(top.name) / col(size.name)), (top, size), config)


def log_return(name: str, half_life, normalized: bool = False) -> Node:
    return Ewma(name, call("log_mid_return") * 1e4, half_life=half_life, normalized=normalized, tag="log_return_bps")


def ewma_var(name: str, half_life, normalized: bool = False) -> Node:
    square = Ewma(f"__{name}_square", call("log_mid_return") * call("log_mid_return"), half_life=half_life, normalized=normalized, tag="squared_return")
    return Node(name, call("sqrt", col(square.name)) * 1e4, (square,), {"ewma_var": {"half_life": _plain(half_life)}})


def ewma_spread(name: str, half_life) -> Node:
    return Ewma(name, call("spread_bps"), half_life=half_life, normalized=True, tag="spread_bps")


def standard_set(half_lives: Sequence[str], depth: int = 3, total_size: float = 5.0) -> tuple[dict[str, Tree], list[Node]]:
    """(static columns, stateful features): the usual mix for a book of ``depth`` levels, seven features per half-life."""
    static = {
        "imbalance_1": call("book_imbalance", 1, True), f"imbalance_{depth}": call("book_imbalance", depth, True), f"imbalance_{depth}_lin": call("book_imbalance", depth),
        "price_gap": call("price_gap", depth, total_size), "swap": call("swap_price", depth, total_size), "spread_bps": call("spread_bps"),
    }
    nodes = []
    for h in half_lives:
        nodes += [
            trade_momentum(f"trade_{h}", h, log=True), push_momentum(f"push_{h}", h, log=True), pull_momentum(f"pull_{h}", h, log=True),
            trade_correlation(f"corr_{h}", h), log_return(f"return_{h}", h), ewma_var(f"var_{h}", h), ewma_spread(f"spread_{h}", h),
        ]
    return static, nodes
