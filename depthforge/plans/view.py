"""Series, layers and panels of a plot as bounded frames; drawing is up to the caller."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthforge.functions.bounds import between
from depthforge.operators import sampling
from depthforge.operators.filters import all_of, valid_price


@dataclass(frozen=True)
class Series:
    """A line, step level or event series; y is a column or an expression."""

    name: str
    y: str | Column
    kind: str = "line"
    secondary: bool = False

    def __post_init__(self):
        if self.kind not in ("line", "level", "event"):
            raise ValueError("a series is a line, level or event")


@dataclass(frozen=True)
class Layer:
    """Series of one frame; all filters must hold."""

    source: DataFrame
    series: Sequence[Series]
    filters: Sequence[Column] = ()
    time: str = "ts_event"
    keys: Sequence[str] = ()
    order: str = "row_nr"


@dataclass(frozen=True)
class Panel:
    layers: Sequence[Layer]
    title: str = ""
    height: float = 1.0


@dataclass
class View:
    panels: Sequence[Panel]
    start: object | None = None
    end: object | None = None
    timezone: str = "UTC"
    points: int = 5000
    cut: list = field(default_factory=list)

    def frames(self) -> list[list[DataFrame]]:
        """For each panel, a frame (time, row, series..., local time) for each layer, of about ``points`` rows a key at most.

        Event layers are kept whole or, beyond the budget, cut to evenly spaced rows; ``cut`` names those.
        """
        self.cut = []
        return [[self._layer(layer) for layer in panel.layers] for panel in self.panels]

    def _layer(self, layer: Layer) -> DataFrame:
        ys = {s.name: (F.col(s.y) if isinstance(s.y, str) else s.y) for s in layer.series}
        rows = layer.source.where(all_of(layer.filters) & between(F.col(layer.time), self.start, self.end, self.timezone))
        out = rows.select(*layer.keys, layer.time, layer.order, *(y.alias(n) for n, y in ys.items()), sampling.display_time(F.col(layer.time), self.timezone).alias("local_time"))
        if all(s.kind == "level" for s in layer.series) and len(layer.series) == 1:
            return sampling.level_changes(out, layer.series[0].name, self.points, layer.keys, layer.order)
        if any(s.kind == "event" for s in layer.series):
            if not out.limit(self.points + 1).count() > self.points:
                return out
            self.cut += [s.name for s in layer.series]
        return sampling.uniform(out, self.points, layer.keys, layer.order)


ACTIONS = {"A": "add", "C": "cancel", "M": "modify", "T": "trade", "F": "fill", "R": "clear"}
SIDES = {"B": "bid", "A": "ask", "N": "none"}


def event_traces(events: DataFrame, actions: Sequence[str] = tuple(ACTIONS), sides: Sequence[str] = tuple(SIDES)) -> DataFrame:
    """Events of the wanted actions and sides with a ``trace`` label; one scan for all traces."""
    label = F.lit(None).cast("string")
    for a in actions:
        for s in sides:
            label = F.when((F.col("action") == a) & (F.col("side") == s), f"{ACTIONS[a]} {SIDES[s]}").otherwise(label)
    return events.where(F.col("action").isin(*actions) & F.col("side").isin(*sides)).withColumn("trace", label)


def book_panel(depth: DataFrame, levels: int, time: str = "ts_event", scale: float = 1e9) -> Panel:
    """Step series of the prices of ``levels`` levels of both sides, empty ones as gaps."""
    layers = []
    for side in ("bid", "ask"):
        for i in range(levels):
            price = F.when(valid_price(f"{side}_px_{i}", f"{side}_sz_{i}"), F.col(f"{side}_px_{i}") / scale)
            layers.append(Layer(depth, [Series(f"{side}_{i}", price, "level")], time=time))
    return Panel(layers, "book")
