"""Declarations: grids, thresholds, nodes and their JSON form."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import NamedTuple

MIN_BIN_N = 30  # observations that a cell needs for a probability
N_REPLICATES = 1000
SEED = 20260907
P_THRESHOLD = 0.05
OHLCV = ("open", "high", "low", "close", "volume")


@dataclass(frozen=True)
class Grid:
    """Signed barriers and forward horizons."""

    barriers: tuple[float, ...]
    horizons: tuple[int, ...]

    @classmethod
    def percent(cls, low: int, high: int, step: int, horizons: tuple[int, ...]) -> Grid:
        """Barriers of whole percents; i / 100 is the same double in every engine."""
        return cls(tuple(i / 100 for i in range(low, high + 1, step)), tuple(horizons))

    @property
    def positive(self) -> tuple[float, ...]:
        return tuple(b for b in self.barriers if b >= 0)


DEFAULT_GRID = Grid.percent(-20, 20, 1, tuple(range(1, 31)))


@dataclass(frozen=True)
class Node:
    """One condition: a feature with parameters, over named data sources."""

    id: str
    feature: str
    params: dict = field(default_factory=dict)
    family: str = "default"
    category: str = ""
    data: tuple[str, ...] = ("ohlcv",)
    derived_from: str | None = None


@dataclass(frozen=True)
class WorkspaceConfig:
    """Settings of one study."""

    start_date: str
    asset: dict = field(default_factory=dict)
    min_obs: int = 100
    grid: Grid = DEFAULT_GRID
    n_bins: int = 10
    target_barrier: float | None = None
    target_horizon: int | None = None
    min_dev: float = 0.10
    min_bin_n: int = 50
    min_run: int = 2

    @property
    def horizon_unit(self) -> str:
        """The letter of the bars' interval where it is hours, days for all others."""
        letter = f"{self.asset.get('interval') or 'd'}"[-1]
        return letter if letter == "h" else "d"

    @property
    def middle_horizon(self) -> int:
        return self.target_horizon or self.grid.horizons[len(self.grid.horizons) // 2]


@dataclass(frozen=True)
class Workspace:
    """A study's settings and nodes by family."""

    config: WorkspaceConfig
    families: dict[str, tuple[Node, ...]]

    def nodes(self) -> Iterator[Node]:
        for family in self.families.values():
            yield from family

    def node(self, node_id: str) -> Node:
        for n in self.nodes():
            if n.id == node_id:
                return n
        raise ValueError(f"no node {node_id!r} is declared")


class _Field(NamedTuple):
    """A setting of a declaration: where it may stand (dotted, older spellings last), its kind, default and bounds."""

    places: tuple[str, ...]
    kind: Callable
    default: object = None
    low: float = -math.inf
    high: float = math.inf

    def of(self, raw: dict):
        for place in self.places:
            at: object = raw
            for step in place.split("."):
                at = at.get(step) if isinstance(at, dict) else None
            if at is not None:
                break
        else:
            if self.default is REQUIRED:
                raise ValueError(f"the declaration lacks {self.places[0]}")
            return self.default
        value = self.kind(at)
        if isinstance(value, float) and not self.low <= value <= self.high:  # also refuses what is not a number
            raise ValueError(f"{self.places[0]} is {value}, outside {self.low} to {self.high}")
        return value


REQUIRED = object()
#: Factors that turn a declared least shift into a difference of probabilities.
SHIFT_UNITS = {"percentage_points": 0.01, "probability_difference": 1.0}
_FIELDS = {
    "start_date": _Field(("start_date",), str, REQUIRED),
    "asset": _Field(("asset",), dict, {}),
    "min_obs": _Field(("min_obs",), int, 100),
    "n_bins": _Field(("n_bins",), int, 10),
    "target_barrier": _Field(("target.barrier", "target.Delta", "target.Δ"), float),
    "target_horizon": _Field(("target.horizon",), int),
    "min_bin_n": _Field(("evaluate.min_bin_n",), int, 50),
    "min_run": _Field(("evaluate.min_run",), int, 2),
}


def _barriers(meta: dict) -> tuple[float, ...]:
    """Evenly spaced barriers with both ends."""
    low, high, step = (
        _Field(tuple(f"{name}.{end}" for name in ("barriers", "Delta", "Δ")), float, default).of(meta)
        for end, default in (("min", -0.20), ("max", 0.20), ("step", 0.01))
    )
    if step <= 0 or high < low:
        raise ValueError("barriers need a positive step and min <= max")
    n = round((high - low) / step) + 1
    return tuple(round(low + (high - low) * i / max(1, n - 1), 10) for i in range(n))


def parse_config(meta: dict) -> WorkspaceConfig:
    """Settings from the ``meta`` object; the least shift is in percentage points unless its unit says otherwise."""
    settings = {name: f.of(meta) for name, f in _FIELDS.items()}
    unit = _Field(("evaluate.shift_unit",), str, "percentage_points").of(meta)
    if unit not in SHIFT_UNITS:
        raise ValueError(f"shifts are measured in {' or '.join(SHIFT_UNITS)}, not in {unit}")
    top = 1 / SHIFT_UNITS[unit]
    least = _Field(("evaluate.min_dev",), float, 0.10 * top, 0.0, top).of(meta)
    first, last = _Field(("horizons.min",), int, 1).of(meta), _Field(("horizons.max",), int, 30).of(meta)
    return WorkspaceConfig(grid=Grid(_barriers(meta), tuple(range(first, last + 1))), min_dev=least / top, **settings)


def _node(family: str, raw: dict) -> Node:
    return Node(raw["id"], raw["feature"], dict(raw.get("params") or {}), raw.get("family", family), raw.get("category", ""), tuple(raw.get("data") or ("ohlcv",)), raw.get("derived_from"))


def parse_workspace(raw: dict) -> Workspace:
    parts = {name: _Field((name,), dict, REQUIRED).of(raw) for name in ("meta", "families")}
    return Workspace(parse_config(parts["meta"]), {family: tuple(_node(family, n) for n in nodes) for family, nodes in parts["families"].items()})


def load_workspace(path: str | Path) -> Workspace:
    return parse_workspace(json.loads(Path(path).read_text(encoding="utf-8")))
