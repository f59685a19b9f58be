"""Expressions as data: trees that compile to columns and to JSON.

A tree is an operation with arguments, which are trees or plain values.  Called with the row window it gives the column,
so it stands wherever a feature takes a function of that window; unlike a function it can be written down and read back.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from depthforge.functions import exprs as X

Plain = str | float | int | bool | None


def _pairwise(f):
    return lambda w, *xs: reduce(f, xs)


#: Operations over columns: of the window and the compiled arguments.  ``over`` divides by what is never 0.
OVER_COLUMNS: dict[str, Callable] = {
    "add": _pairwise(lambda a, b: a + b), "sub": _pairwise(lambda a, b: a - b), "mul": _pairwise(lambda a, b: a * b), "div": lambda w, a, b: X.fdiv(a, b), "over": lambda w, a, b: a / b, "neg": lambda w, a: -a,
    "gt": lambda w, a, b: a > b, "ge": lambda w, a, b: a >= b, "lt": lambda w, a, b: a < b, "le": lambda w, a, b: a <= b, "eq": lambda w, a, b: a == b, "ne": lambda w, a, b: a != b,
    "and": _pairwise(lambda a, b: a & b), "or": _pairwise(lambda a, b: a | b), "not": lambda w, a: ~a, "is_null": lambda w, a: a.isNull(),
    "abs": lambda w, a: F.abs(a), "log": lambda w, a: X.flog(a), "log1p": lambda w, a: X.flog1p(a), "sqrt": lambda w, a: X.fsqrt(a), "sign": lambda w, a: F.signum(a),
    "least": lambda w, *xs: F.least(*xs), "greatest": lambda w, *xs: F.greatest(*xs), "coalesce": lambda w, *xs: F.coalesce(*xs), "num": lambda w, a: X.num(a),
    "if": lambda w, test, then, other=None: F.when(test, then) if other is None else F.when(test, then).otherwise(other), "lag": lambda w, a: F.lag(a).over(w),
}

#: The library's own columns: of the window and plain arguments.
OVER_VALUES: dict[str, Callable] = {
    "col": lambda w, name: F.col(name), "lit": lambda w, value: F.lit(value), "bbo_volume": lambda w: X.bbo_volume(), "mid": lambda w: X.mid(), "bbo_valid": lambda w: X.bbo_valid(),
    "spread_bps": lambda w: X.spread_bps(), "log_mid_return": lambda w: X.log_mid_return(w), "is_trade": lambda w: X.is_trade(), "signed_trade": lambda w, mode: X.signed_trade(mode),
    "flow": lambda w, mode, side, unit=False: X.flows(mode, w, unit)[("buy", "sell").index(side)], "book_imbalance": lambda w, depth, log=False, eps=1e-12: X.book_imbalance(depth, log, eps),
    "price_gap": lambda w, depth, size, log=False, eps=1e-12: X.size_weighted_price_gap(depth, size, log, eps), "swap_price": lambda w, depth, size: X.size_weighted_price(depth, size),
}

#: Columns, then plain arguments.
OVER_BOTH: dict[str, tuple[int, Callable]] = {
    "combine_flows": (2, lambda w, buy, sell, combine="diff", log=False, eps=1e-12: X.combine_flows(buy, sell, combine, log, eps)),
    "balance": (2, lambda w, a, b, log=False, eps=1e-12: X.balance(a, b, log, eps)),
}


@dataclass(frozen=True, eq=False)
class Tree:
    op: str
    args: tuple = ()

    def __post_init__(self):
        if self.op not in OVER_COLUMNS and self.op not in OVER_VALUES and self.op not in OVER_BOTH:
            raise ValueError(f"unknown operation {self.op!r}")

    def __call__(self, w=None) -> Column:
        """The column, with ``w`` as the window of neighbouring rows."""
        if self.op in OVER_VALUES:
            return OVER_VALUES[self.op](w, *self.args)
        n, f = OVER_BOTH.get(self.op, (len(self.args), OVER_COLUMNS.get(self.op)))
        return f(w, *(tree(a)(w) for a in self.args[:n]), *self.args[n:])

    def to_config(self) -> list:
        """[operation, arguments...], trees being lists."""
        return [self.op, *(a.to_config() if isinstance(a, Tree) else a for a in self.args)]

    def to_json(self) -> str:
        return json.dumps(self.to_config())

    @staticmethod
    def from_config(config: list) -> Tree:
        if not isinstance(config, list) or not config or not isinstance(config[0], str):
            raise ValueError(f"not an expression: {config!r}")
        return Tree(config[0], tuple(Tree.from_config(a) if isinstance(a, list) else a for a in config[1:]))

    @staticmethod
    def from_json(text: str) -> Tree:
        return Tree.from_config(json.loads(text))

    def columns(self) -> list[str]:
        """The columns it names, in order of appearance; not those that the library's own columns read."""
        if self.op == "col":
            return [self.args[0]]
        return list(dict.fromkeys(c for a in self.args if isinstance(a, Tree) for c in a.columns()))

    def __add__(self, o):
        return Tree("add", (self, tree(o)))

    def __radd__(self, o):
        return Tree("add", (tree(o), self))

    def __sub__(self, o):
        return Tree("sub", (self, tree(o)))

    def __rsub__(self, o):
        return Tree("sub", (tree(o), self))

    def __mul__(self, o):
        return Tree("mul", (self, tree(o)))

    def __rmul__(self, o):
        return Tree("mul", (tree(o), self))

    def __truediv__(self, o):
        return Tree("div", (self, tree(o)))

    def __rtruediv__(self, o):
        return Tree("div", (tree(o), self))

    def __neg__(self):
        return Tree("neg", (self,))

    def __gt__(self, o):
        return Tree("gt", (self, tree(o)))

    def __ge__(self, o):
        return Tree("ge", (self, tree(o)))

    def __lt__(self, o):
        return Tree("lt", (self, tree(o)))

    def __le__(self, o):
        return Tree("le", (self, tree(o)))

    def __and__(self, o):
        return Tree("and", (self, tree(o)))

    def __or__(self, o):
        return Tree("or", (self, tree(o)))

    def __invert__(self):
        return Tree("not", (self,))


def tree(x: Tree | Plain) -> Tree:
    """``x``, a plain value as a literal."""
    return x if isinstance(x, Tree) else Tree("lit", (x,))


def col(name: str) -> Tree:
    return Tree("col", (name,))


def call(op: str, *args) -> Tree:
    return Tree(op, args)


def same(a: Tree, b: Tree) -> bool:
    return a.to_config() == b.to_config()
