"""Generated boards of rectangles, with closed forms to hold results against."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ohmgrid.functions.units import COPPER_CONDUCTIVITY

RECT = "study string, layer int, x0 double, y0 double, x1 double, y1 double"


@dataclass
class Board:
    """Copper rectangles, pads (contacts), vias and layers of one study; lengths in metres."""

    study: str
    copper: list[tuple[int, float, float, float, float]]
    pads: dict[str, list[tuple[int, float, float, float, float]]]
    thickness: float = 35e-6
    layers: dict[int, float] = field(default_factory=lambda: {0: 0.0})
    vias: list[tuple[str, float, float, float]] = field(default_factory=list)
    expected: float | None = None

    def rectangles(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.study, *r) for r in self.copper], RECT)


def straight_trace(length: float = 20e-3, width: float = 1e-3, pad: float = 1e-3, thickness: float = 35e-6) -> Board:
    """A trace between full-width pads: R = L / (sigma w t) over the copper between them."""
    copper = [(0, -pad, 0.0, length + pad, width)]
    pads = {"source": [(0, -pad, 0.0, 0.0, width)], "load": [(0, length, 0.0, length + pad, width)]}
    return Board("straight_trace", copper, pads, thickness, expected=length / (COPPER_CONDUCTIVITY * width * thickness))


def parallel_traces(length: float = 20e-3, widths: tuple[float, float] = (1e-3, 2e-3), pad: float = 1e-3, thickness: float = 35e-6) -> Board:
    """Two traces that share both pads: conductances add."""
    gap, (a, b) = 1e-3, widths
    copper = [(0, 0.0, 0.0, length, a), (0, 0.0, a + gap, length, a + gap + b), (0, -pad, 0.0, 0.0, a + gap + b), (0, length, 0.0, length + pad, a + gap + b)]
    pads = {"source": [(0, -pad, 0.0, 0.0, a + gap + b)], "load": [(0, length, 0.0, length + pad, a + gap + b)]}
    return Board("parallel_traces", copper, pads, thickness, expected=length / (COPPER_CONDUCTIVITY * (a + b) * thickness))


def series_widths(length: float = 20e-3, widths: tuple[float, float] = (2e-3, 1e-3), pad: float = 1e-3, thickness: float = 35e-6) -> Board:
    """Two widths in a row: the sum of both, and a few percent for the constriction."""
    a, b = widths
    copper = [(0, -pad, 0.0, length, a), (0, length, 0.0, 2 * length + pad, b)]
    pads = {"source": [(0, -pad, 0.0, 0.0, a)], "load": [(0, 2 * length, 0.0, 2 * length + pad, b)]}
    return Board("series_widths", copper, pads, thickness, expected=sum(length / (COPPER_CONDUCTIVITY * w * thickness) for w in widths))


def plane_neck_plane(side: float = 8e-3, neck: tuple[float, float] = (2e-3, 0.2e-3), pad: float = 1e-3, thickness: float = 35e-6) -> Board:
    """Two planes joined by a narrow neck, whose corners are where errors gather."""
    length, width = neck
    low = (side - width) / 2
    copper = [(0, 0.0, 0.0, side, side), (0, side, low, side + length, low + width), (0, side + length, 0.0, 2 * side + length, side)]
    pads = {"source": [(0, 0.0, 0.0, pad, side)], "load": [(0, 2 * side + length - pad, 0.0, 2 * side + length, side)]}
    return Board("plane_neck_plane", copper, pads, thickness)


def via_stack(n_layers: int = 2, drop: float = 1.6e-3, hole: float = 0.3e-3, plating: float = 25e-6, side: float = 4e-3) -> Board:
    """Pads that cover whole layers, joined by one plated barrel: the barrel alone is the resistance."""
    layers = {k: k * drop for k in range(n_layers)}
    copper = [(k, 0.0, 0.0, side, side) for k in layers]
    pads = {"source": [(0, 0.0, 0.0, side, side)], "load": [(n_layers - 1, 0.0, 0.0, side, side)]}
    outer = hole / 2 + plating
    area = math.pi * (outer**2 - (hole / 2) ** 2)
    board = Board("via_stack", copper, pads, layers=layers, vias=[("v1", side / 2, side / 2, area)])
    board.expected = drop * (n_layers - 1) / (COPPER_CONDUCTIVITY * area)
    return board


def islands() -> Board:
    """Source and load on separate copper: refused."""
    copper = [(0, 0.0, 0.0, 2e-3, 2e-3), (0, 4e-3, 0.0, 6e-3, 2e-3)]
    return Board("islands", copper, {"source": [copper[0]], "load": [copper[1]]})
